"""Merkle fingerprints of documents.

Leaves are the sentences of a paragraph (a paragraph is a line), a paragraph's node hashes its leaves' hashes, a section's node those of a run
of paragraphs, and the root those of the sections. A section ends after a paragraph whose own hash begins with 0 or 1, so an insertion
moves no boundary but its own. Leaves keep every character, so equal roots mean equal texts (up to hash collisions), and the nodes that
differ locate an edit.

The fingerprint text is ``root/sections/leaves``: the root (32 digits), the section nodes in order (8 digits each, one for about eight lines) and the
``SKETCH`` least of the distinct leaf hashes (12 digits each), so its length is bounded but for the sections. Likeness of two fingerprints: 1 for
equal roots, else the Dice coefficient of their leaves by the least ``SKETCH`` of both together, which is exact while these are all.

Defined cases: a null text is an empty text; an empty text has one empty paragraph and no leaves, so its likeness to any other text
is 0; very long texts and texts of many lines cost a time in proportion to their length; an empty table gives no rows; extra columns are ignored.
Documents with equal ids follow each other in the order of their texts' MD5; those without an id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A sentence with its end marks, or end marks alone; together they cover a line.
LEAF = r"[^.!?]+[.!?]*|[.!?]+"
#: Leaf hashes in a fingerprint.
SKETCH = 256
#: Documents in a slice of the id order, most quantiles that divide it, and most slices.
SLICE_ROWS, MAX_KNOTS, MAX_SLICES = 1000, 1 << 15, 1 << 20


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _tree(text: Column) -> Column:
    """struct(root, sections, leaves) of a non-null text."""

    def nodes(leaves: Column) -> Column:
        paragraphs = F.transform(leaves, lambda line: F.substring(F.md5(F.array_join(line, "")), 1, 16))
        joined = F.regexp_replace(F.array_join(paragraphs, " "), r"\b([01][0-9a-f]{15}) ", "$1|")
        short = F.transform(F.flatten(leaves), lambda x: F.substring(x, 1, 12))
        return F.struct(
            F.transform(F.split(joined, r"\|"), lambda s: F.md5(s)).alias("sections"),
            F.slice(F.sort_array(F.array_distinct(short)), 1, SKETCH).alias("leaves"),
        )

    hashed = F.transform(
        F.split(text, "\n", -1), lambda line: F.transform(F.regexp_extract_all(line, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x))
    )
    root = lambda t: F.struct(F.md5(F.array_join(t["sections"], " ")).alias("root"), t["sections"].alias("sections"), t["leaves"].alias("leaves"))
    return _let(_let(hashed, nodes), root)


def fingerprint(tree: Column) -> Column:
    """The text form of a tree."""
    return F.concat_ws(
        "/",
        tree["root"],
        F.array_join(F.transform(tree["sections"], lambda s: F.substring(s, 1, 8)), ""),
        F.array_join(tree["leaves"], ""),
    )


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two trees."""
    least = F.slice(F.sort_array(F.array_distinct(F.concat(a["leaves"], b["leaves"]))), 1, SKETCH)
    common = F.size(F.array_intersect(least, F.array_intersect(a["leaves"], b["leaves"])))
    dice = _let(least, lambda x: 2.0 * common / (F.size(x) + common))
    return (
        F.when(a["root"] == b["root"], F.lit(1.0))
        .when(F.size(a["leaves"]) + F.size(b["leaves"]) == 0, F.lit(0.0))
        .otherwise(dice)
        .cast("double")
    )


def n_changed(a: Column, b: Column) -> Column:
    """How many distinct sections of ``a`` the tree ``b`` does not have."""
    return F.size(F.array_except(a["sections"], b["sections"]))


def changed_sections(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, section: positions (from 0) of the sections of text ``before`` that ``after`` does not have: the branches that locate an edit."""
    text = lambda c: _tree(F.coalesce(F.col(c), F.lit("")))["sections"]
    both = pairs.select(key, text(before).alias("a"), text(after).alias("b"))
    old = both.select(key, F.posexplode("a").alias("section", "node"))
    return old.join(both.select(key, F.explode("b").alias("node")), [key, "node"], "left_anti").select(key, "section")


def _sliced(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, ``_k`` (descending key as an ascending number), ``_h`` (MD5 of the text) and the number of the slice of that order.

    Quantiles of the key divide the table into as many slices as its rows ask for; a key that is a quantile, as a frequent one is, has slices of its own,
    divided by the hash, and so have rows without a key.
    """
    n = docs.count()
    knots = max(1, min(MAX_KNOTS, n // SLICE_ROWS))
    parts = max(1, min(n // SLICE_ROWS + 1, MAX_SLICES // knots))
    # One literal, where an array of literals would be an expression each.
    share = F.split(F.lit(",".join(str(k / knots) for k in range(knots + 1))), ",").cast("array<double>")
    bounds = docs.agg(F.array_distinct(F.percentile_approx(key, share, min(10 * knots, 1 << 20))).alias("_q"))
    bounds = bounds.select("_q", F.expr("transform(sequence(0, greatest(size(_q) - 1, 0) div 256), i -> get(_q, i * 256))").alias("_coarse"))
    rows = docs.select(key, text, F.bitwise_not(key).alias("_k"), F.md5(text).alias("_h")).crossJoin(F.broadcast(bounds))
    rows = rows.withColumn("_c", F.greatest(F.size(F.filter("_coarse", lambda k: k <= F.col(key))) - 1, F.lit(0)))
    fine = F.filter(F.slice("_q", F.col("_c") * 256 + 1, F.lit(256)), lambda k: k <= F.col(key))
    at = F.col("_c") * 256 + F.size(fine) - 1
    sub = parts - 1 - F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * parts / (1 << 32))
    rows = rows.withColumn("_at", at).withColumn("_own", F.coalesce(F.get("_q", F.greatest("_at", F.lit(0))) == F.col(key), F.lit(False)))
    slot = F.when(F.col(key).isNull(), F.lit(0)).otherwise(2 * F.col("_at") + F.when(F.col("_own"), 3).otherwise(4)).cast("long")
    split = F.col(key).isNull() | F.col("_own")
    return rows.select(key, text, "_k", "_h", (slot * parts + F.when(split, sub).otherwise(0)).alias("_slice"))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and ``next_text``: the text of the row with the next smaller key; after the last, that of the first.

    Rows are dealt into slices of the key's order and each slice is sorted by itself. The first row of a slice is also dealt
    to the slice before it, where it comes last and is dropped again, so texts move once. The table of first rows, a number and a hash each, has
    at most 2 * ``MAX_SLICES`` rows, which bounds its broadcast.
    """
    sliced = _sliced(docs, key, text)
    heads = sliced.groupBy("_slice").agg(F.min(F.struct("_k", "_h")).alias("_head"))
    order = W.orderBy(F.col("_slice"))
    ends = W.orderBy("_slice").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select(
        "_slice", "_head", F.coalesce(F.lead("_slice").over(order), F.first("_slice").over(ends)).alias("_above")
    )
    own = F.struct(F.col("_slice").alias("slice"), F.lit(0).alias("extra"))
    other = F.struct(F.col("_above").alias("slice"), F.lit(1).alias("extra"))
    dealt = (
        sliced.join(F.broadcast(heads), "_slice", "left")
        .withColumn("_d", F.explode(F.when(F.struct("_k", "_h") == F.col("_head"), F.array(own, other)).otherwise(F.array(own))))
        .select(key, text, "_k", "_h", "_d.slice", "_d.extra")
    )
    w = W.partitionBy("slice").orderBy("extra", "_k", "_h")
    return dealt.withColumn("next_text", F.lead(text).over(w)).where("extra = 0").select(key, text, "next_text")


def op4(docs: DataFrame) -> DataFrame:
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    half = F.expr("n_chars div 2").cast("int")
    df = with_next(base, "doc_id", "text").withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn(
        "edited",
        F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)),
    )
    for name, tree in (("text", "_a"), ("edited", "_b"), ("next_text", "_c")):
        df = df.withColumn(tree, _tree(F.col(name)))
    a, b, c = (F.col(x) for x in ("_a", "_b", "_c"))
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(a).alias("fingerprint"),
        fingerprint(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"),
        likeness(a, c).alias("near_next"),
        n_changed(a, b).alias("n_changed_sections"),
    )
