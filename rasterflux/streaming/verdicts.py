"""Verdicts of pixels over a stream of scenes in event time: late scenes are judged again, and state ends.

A pixel's state is a map from date to difference. A scene that comes late, but before the watermark, goes to its own place among the dates and the verdict is given again; a timer at the latest scene's time
plus the horizon gives the final verdict and clears the pixel, so state is bounded by the dates within a horizon and the pixels seen in it, not by the stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rasterflux.shipping import ship
from rasterflux.streaming.persistence import _rule

OUT = "r int, c int, n int, change_index int, confirmations int, persistent boolean, final boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SETTING = "spark.sql.streaming.stateStore.providerClass"


class Verdicts(StatefulProcessor):
    """One pixel at a time: dates, the time of the latest scene, and a timer."""

    def __init__(self, threshold: float, min_persist: int, horizon_ms: int) -> None:
        self.threshold, self.min_persist, self.horizon_ms = threshold, min_persist, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dates = handle.getMapState("dates", "t int", "diff double")
        self.latest = handle.getValueState("latest", "ms long")

    def _verdict(self, key: tuple, final: bool) -> pd.DataFrame:
        known = sorted((t[0], d[0]) for t, d in self.dates.iterator())
        at, n, sure = _rule([t for t, _ in known], [d for _, d in known], self.threshold, self.min_persist)
        return pd.DataFrame([{"r": key[0], "c": key[1], "n": len(known), "change_index": at, "confirmations": n, "persistent": sure, "final": final}])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        newest = before = self.latest.get()[0] if self.latest.exists() else None
        for pdf in rows:
            for t, diff, seen in zip(pdf["t"], pdf["diff"], pdf["seen"], strict=True):
                self.dates.updateValue((int(t),), (float(diff),))
                ms = int(pd.Timestamp(seen).value // 1_000_000)
                newest = ms if newest is None else max(newest, ms)
        if newest != before:
            if before is not None:
                self.handle.deleteTimer(before + self.horizon_ms)
            self.handle.registerTimer(newest + self.horizon_ms)
            self.latest.update((newest,))
        yield self._verdict(key, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        yield self._verdict(key, True)
        self.dates.clear()
        self.latest.clear()

    def close(self) -> None:
        """Nothing is held outside of the state."""


def stream_verdicts(observations: DataFrame, threshold: float, horizon: int, lateness: str, min_persist: int = 1) -> DataFrame:
    """The verdict of a pixel after each batch with scenes of it, and once more when it ends (``final``), from a stream of valid differences (r, c, t, seen, diff).

    ``seen`` is the scene's time. A scene more than ``lateness`` (such as "10 days") behind the newest of all may be left out. A pixel ends ``horizon`` days after its latest scene; what comes
    later starts anew. Needs the state store of ``PROVIDER``.
    """
    spark = observations.sparkSession
    ship(spark)
    if not str(spark.conf.get(_SETTING, "")).endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"{_SETTING} must be {PROVIDER}")
    keyed = observations.select("r", "c", "t", "seen", "diff").withWatermark("seen", lateness).groupBy("r", "c")
    return keyed.transformWithStateInPandas(Verdicts(threshold, min_persist, horizon * 86_400_000), OUT, "update", "eventTime")
