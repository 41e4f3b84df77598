"""Proportional stratified interleaving.

Each source's rows are shuffled by a seeded hash and ranked; the fractional rank (r - 1 + v) / n, with v in [0, 1) a seeded start of
the source, spreads every source evenly over [0, 1), so any contiguous cut of the rows in that order holds the mixture to within one row a
source. The order is cut into shards whose row counts differ by one at most (law ``rows``). Both rankings are sliced by as many parts as
there are rows to sort, and the starts keep sources of one row apart: no task ever holds a whole source, nor all small ones.

Equal texts are rows like any others: law ``rows`` keeps no groups together, and copies fall into shards as their hashes say.

Defined cases: a null source is a stratum of its own, a null text has size 1 and CRC 0, repeated rows are ranked one after
the other, rows without an id are shuffled by their texts, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflux.llm.common import materialize, ordered_prefix


def _unit(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 12) / F.lit(float(1 << 52))


def interleave(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, source key, shard and slot of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    crc = F.crc32(text)
    slim = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
        (F.length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        _unit(F.lit(seed), F.col("doc_id"), crc).alias("u"),
    )
    slim = materialize(slim, "shard-rows")
    ranked = ordered_prefix(slim, ["stratum"], "u", ["doc_id", "text_crc32", "size"])
    start = _unit(F.lit(seed + 1), F.col("stratum"))
    ranked = ranked.withColumn("f", (F.col("rank") - 1 + start) / F.col("group_rows"))
    ranked = materialize(ranked.select("doc_id", "stratum", "size", "text_crc32", "f"), "shard-ranks")
    placed = ordered_prefix(ranked, [], "f", ["stratum"])
    shard = F.expr(f"((rank - 1) * {shards}) div group_rows")
    first = F.expr(f"(shard * group_rows + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard)
        .withColumn("slot", F.col("rank") - 1 - first)
        .select("doc_id", "stratum", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
    )


def op6(docs: DataFrame) -> DataFrame:
    return interleave(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
