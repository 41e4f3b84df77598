"""Shared pieces of the corpus operators: words, hashes, Arrow tasks, distributed ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflux.operators.graph import connected, numbered
from rasterflux.shipping import ship
from rasterflux.storage import discard, materialize, table

__all__ = ["BLANKS", "arrow", "connected", "discard", "fresh", "materialize", "numbered", "ordered_prefix", "table", "unit_hash", "words"]

#: The six ASCII blanks that separate words.
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


#: Rows of a batch that is handed to Python: whole texts may be long, and a batch is held several times over.
BATCH_ROWS = 1000


def arrow(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers can import this package, in batches of at most ``BATCH_ROWS`` rows."""
    spark = df.sparkSession
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return df.mapInArrow(task, schema)


def unit_hash(seed: str, *cols: Column) -> Column:
    """Uniform number in [0, 1) from the MD5 of seed and columns (52 bits), the same in any SQL engine."""
    key = F.concat(F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("?")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def ordered_prefix(
    df: DataFrame,
    group: list[str],
    key: str,
    ties: list[str],
    sums: dict[str, str] | None = None,
    rows_per_slice: int = 1000,
    most_slices: int = 1 << 16,
) -> DataFrame:
    """Ranks rows by (key, ties) inside each group without bringing a group to one task.

    ``key`` is a double in [0, 1], spread evenly within a group. A group's rows fall into equal slices of the key, as many as its rows ask
    for up to ``most_slices``, so a slice, never a group, is the unit of sorting; totals of the slices (pre-aggregated) give each slice its offset, by a
    window over a group's slices. Adds ``rank`` (from 1), ``group_rows`` and, for each entry of ``sums`` (new name -> long column), the sum of that
    column over the rows before. Rows equal in key and all ties must be interchangeable.
    """
    sums = sums or {}
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias("group_rows"))
    df = df.join(counted, group) if group else df.crossJoin(F.broadcast(counted))
    many = F.least(F.lit(most_slices), 1 + F.floor(F.col("group_rows") / rows_per_slice))
    df = df.withColumn("_b", F.least(many - 1, F.floor(F.col(key) * many)))
    parts = df.groupBy(*group, "_b").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()]
    )
    # With no group this window runs in one task, over one row per slice.
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        *group,
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums],
    )
    inside = W.partitionBy(*group, "_b").orderBy(key, *ties)
    return (
        df.join(offsets, [*group, "_b"])
        .withColumn("rank", F.col("_rows_before") + F.row_number().over(inside))
        .withColumns(
            {
                k: F.col(f"_b_{k}")
                + F.coalesce(F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
                for k, c in sums.items()
            }
        )
        .drop("_b", "_rows_before", *[f"_b_{k}" for k in sums])
    )
