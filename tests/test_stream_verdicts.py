"""A shuffled late stream ends in the batch result, and state ends with its timers."""

from __future__ import annotations

import datetime
import random

import pytest

from rasterflux.streaming.persistence import _rule
from rasterflux.streaming.verdicts import _SETTING, PROVIDER, stream_verdicts


def test_needs_the_state_store(spark):
    source = spark.readStream.format("rate").load().selectExpr("1 r", "1 c", "1 t", "timestamp seen", "0.0 diff")
    with pytest.raises(ValueError, match="stateStore"):
        stream_verdicts(source, 0.2, 30, "10 days")


def test_a_late_stream_ends_in_the_batch_result(spark, tmp_path):
    rng = random.Random(4)
    day = lambda k: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k)
    rows = [(r, c, t, day(5 * t), rng.choice([0.0, 0.3, -0.4, 0.5])) for r in range(3) for c in range(2) for t in range(8)]
    # Scenes come up to fifteen days late.
    order = sorted(rows, key=lambda x: x[2] + rng.uniform(0, 3))
    cut = [order[k : k + 12] for k in range(0, len(order), 12)]
    # A pixel elsewhere moves the watermark on until all others have ended.
    cut += [[(9, 9, 100, day(200), 0.0)], [(9, 9, 101, day(201), 0.0)]]
    spark.conf.set(_SETTING, PROVIDER)
    try:
        schema = "r int, c int, t int, seen timestamp, diff double"
        for k, part in enumerate(cut):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{k:02d}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
        out = stream_verdicts(source, 0.2, 30, "20 days")
        query = out.writeStream.outputMode("update").format("memory").queryName("dated").option("checkpointLocation", str(tmp_path / "cp")).start()
        query.processAllAvailable()
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        query.stop()
        said = spark.sql("select * from dated").collect()
    finally:
        spark.conf.unset(_SETTING)
    final = {(x.r, x.c): x for x in said if x.final}
    assert len(final) == 6 and len([x for x in said if x.final]) == 6
    for key, x in final.items():
        known = sorted((t, d) for r, c, t, _, d in rows if (r, c) == key)
        assert (x.n, (x.change_index, x.confirmations, x.persistent)) == (8, _rule([t for t, _ in known], [d for _, d in known], 0.2, 1))
    # Verdicts were given again as late scenes came, and only the last pixel is still held.
    assert len([x for x in said if not x.final]) > 12 and state <= 4
