"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all words, at most ``MAX_COPIES`` times its own words; what a capped source
leaves goes to the others by weight. With rho = target / source words, a document of the source is to be taken
mu = rho + min(rho, 3 - rho) * (w - w') times on average, where w = size / (size + 100) prefers whole articles to fragments and w' is
the mean of w over the source's words, so that the expected words of the source are its target and mu stays between 0 and 3. The floor of mu are
certain whole copies; what remains, p, is the document's inclusion probability of one more.

That one is drawn by Pareto order sampling of fixed size: the documents of a stratum are ranked by the random odds
U / (1 - U), U a hash of id and text, divided by the inclusion odds p / (1 - p), and the first n are taken. A stratum is a source's documents of one
size class (eight a doubling); n is the sum of its p, rounded up or down as the words that larger classes were rounded by ask for, so that little
is left for the smallest class to miss.

Defined cases: a null source comes last in the order of sources and is one source; a null or empty text has size 0 and
takes 0 words; repeated rows are documents of their own; an empty table gives no rows; extra columns are kept out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflux.llm.common import fresh, materialize, ordered_prefix, unit_hash, words
from rasterflux.operators.graph import numbered

MAX_COPIES = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
SEED = "mix-2:"
#: Size classes a doubling of the size; parts in which probabilities are added exactly.
CLASSES, PARTS = 8, 1_000_000


def targets(sizes: DataFrame) -> DataFrame:
    """From one row per source (stratum, source, source_size, source_w): the target of each.

    The water level is found by fixing the capped sources step by step, one aggregation over the sources a step: each step can only cap more, and the
    level is exact once none is added. Sources are numbered by ranges of their order, so nothing needs them all in one task.
    """
    placed = numbered(sizes, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("number") - 1) % len(WEIGHTS) + 1).cast("int"))
    placed = materialize(placed.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * MAX_COPIES}), "mix-sources")
    level, capped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.col("cap")
        row = placed.agg(
            F.sum("source_size").alias("whole"),
            F.sum(F.when(over, F.col("cap"))).alias("full"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
            F.count_if(over).alias("n"),
        ).first()
        if not row.free or row.n == capped:
            break
        level, capped = (row.whole - (row.full or 0)) / row.free, row.n
    share, cap = F.lit(level) * F.col("weight"), F.col("cap").cast("double")
    return placed.select("stratum", "source_size", "source_w", F.least(share, cap).alias("target"))


def sized(docs: DataFrame, *carry: str) -> DataFrame:
    """One slim row per document: id, size in words, its preference in thousandths, size class and U."""
    size = F.size(words(F.col("text"))).cast("long")
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
        size.alias("size"),
        unit_hash(SEED, F.col("doc_id"), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("u"),
        *carry,
    ).withColumns(
        {
            "w": F.expr("(size * 1000) div (size + 100)"),
            # Powers of two and their eighths are exact bounds, so that no logarithm's last digit decides.
            "class": F.expr("length(bin(size)) * 8 + (size * 8) div shiftleft(1L, length(bin(size)) - 1)").cast("int"),
        }
    )


def _expected(df: DataFrame) -> DataFrame:
    """Adds the certain copies and, in millionths, the inclusion probability ``p``."""
    size = F.greatest("source_size", F.lit(1))
    rho = F.col("target") / size
    lean = (F.col("w") * size - F.col("source_w")) / (1000.0 * size)
    mu = F.rint((rho + F.least(rho, MAX_COPIES - rho) * lean) * PARTS).cast("long")
    return df.withColumn("_mu", mu).withColumns({"certain": F.expr(f"_mu div {PARTS}"), "p": F.expr(f"_mu % {PARTS}")}).drop("_mu")


def rounded(stats: DataFrame) -> DataFrame:
    """Adds ``n``, the documents to draw in each size class, from the largest down; words lost or won by rounding are carried on.

    A source has some 300 size classes at most, which come together in one row.
    """
    mean = F.col("sum_ps") / F.greatest("sum_p", F.lit(1))
    entry = F.struct((-F.col("class")).alias("down"), "sum_p", mean.alias("mean"), "class_rows")

    def step(acc: Column, x: Column) -> Column:
        low = F.floor(x["sum_p"] / F.lit(PARTS))
        rest = x["sum_p"] / F.lit(PARTS) - low
        need = acc["carry"] + rest * x["mean"]
        up = (need >= x["mean"] / 2) & (rest > 0)
        return F.struct((need - F.when(up, x["mean"]).otherwise(0.0)).alias("carry"), F.concat(acc["n"], F.array(low + F.when(up, 1).otherwise(0))).alias("n"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("n"))
    per = stats.groupBy("stratum").agg(F.sort_array(F.collect_list(entry)).alias("all"))
    per = per.select("stratum", "all", F.aggregate("all", start, step)["n"].alias("ns"))
    out = per.select("stratum", F.inline(F.arrays_zip("all", "ns")))
    return out.select("stratum", (-F.col("all.down")).alias("class"), "all.sum_p", "all.class_rows", F.col("ns").alias("n"))


def plan(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, size, source_size, target and the number of copies of every document, with carried columns."""
    slim = materialize(sized(docs, *carry), "mix-rows")
    per_source = slim.groupBy("stratum").agg(
        F.first("source").alias("source"), F.sum("size").alias("source_size"), F.sum(F.col("w") * F.col("size")).alias("source_w")
    )
    goal = materialize(targets(per_source), "mix-targets")
    rows = _expected(slim.select("stratum", "class", "size", "w").join(goal, "stratum"))
    stats = rows.groupBy("stratum", "class").agg(F.sum("p").alias("sum_p"), F.sum(F.col("p") * F.col("size")).alias("sum_ps"), F.count(F.lit(1)).alias("class_rows"))
    stats = materialize(rounded(stats).join(goal, "stratum"), "mix-classes")
    ranked = _expected(slim.join(stats, ["stratum", "class"]))
    u, p = F.col("u"), F.col("p") / PARTS
    # The order of a stratum is that of u / (1 - u) / (p / (1 - p)); against the odds of the stratum's mean it is even in [0, 1).
    mean = F.greatest(F.col("sum_p"), F.lit(1)) / (F.col("class_rows") * PARTS)
    a, b = u * (1 - p) * mean, (1 - u) * p * (1 - mean)
    key = F.when(F.col("p") == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(a, a + b), F.lit(0.0)))
    ranked = ordered_prefix(ranked.withColumn("key", key), ["stratum", "class"], "key", ["u", "doc_id", "size"])
    return ranked.withColumn("copies", (F.col("certain") + F.when(F.col("rank") <= F.col("n"), 1).otherwise(0)).cast("int"))


def op3(docs: DataFrame) -> DataFrame:
    return plan(docs).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.col("copies"),
        F.col("p").alias("inclusion_millionths"),
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken, with their own columns.

    The plan is made over slim rows; texts are written once with a row number and meet it in one join.
    """
    row, copy = fresh(docs, "_row"), fresh(docs, "_copy")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    chosen = plan(rows.select("doc_id", "source", "text", F.col(row).alias("_row")), "_row").where("copies > 0")
    chosen = chosen.select(F.col("_row").alias(row), F.sequence(F.lit(1), F.col("copies")).alias(copy))
    return rows.join(chosen, row).select(*docs.columns, F.explode(copy).alias(row)).drop(row)
