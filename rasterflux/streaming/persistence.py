"""Persistence of a pixel over a stream of observations, with the same rule as the batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterflux.shipping import ship

OUT = "r int, c int, n int, change_index int, confirmations int, persistent boolean"
STATE = "steps array<int>, diffs array<double>"


def _rule(steps: list[int], diffs: list[float], threshold: float, min_persist: int) -> tuple[int, int, bool]:
    for i, d in enumerate(diffs):
        if abs(d) < threshold:
            continue
        later = diffs[i + 1 :]
        agree = sum(abs(x) >= threshold and (x > 0) == (d > 0) for x in later)
        if agree == len(later) and (len(later) >= min_persist or not later):
            return steps[i], agree, len(later) >= min_persist
    return -1, 0, False


def stream_persistence(diffs: DataFrame, threshold: float, min_persist: int = 1, most: int | None = None) -> DataFrame:
    """From a stream of valid differences (r, c, t, diff): the pixel's verdict after each batch.

    State is a pixel's dates, all of them: the first crossing may be confirmed by any later one. ``most`` bounds them; a pixel with more stops the query.
    """
    ship(diffs.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, values = state.get if state.exists else ([], [])
        known = dict(zip(steps, values, strict=True))
        for pdf in batches:
            known |= dict(zip(pdf["t"].tolist(), pdf["diff"].tolist(), strict=True))
        if most is not None and len(known) > most:
            raise ValueError(f"pixel {key} has {len(known)} dates, more than {most}")
        steps = sorted(known)
        values = [float(known[t]) for t in steps]
        state.update((steps, values))
        at, n, sure = _rule(steps, values, threshold, min_persist)
        yield pd.DataFrame([{"r": key[0], "c": key[1], "n": len(steps), "change_index": at, "confirmations": n, "persistent": sure}])

    return diffs.groupBy("r", "c").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
