"""Prefix trie of conversations: chained digests of turns, one node for each distinct prefix, sums over subtrees.

A conversation's turns, in order, form a path from the textless root. The digest of a prefix chains SHA-256 over its turns, in two or more levels: inside a
block of ``BLOCK`` turns each digest covers the one before and the turn, and the blocks' last digests are chained in the same way, so a conversation
of any length costs a group of at most ``BLOCK`` rows. Prefixes are exploded and grouped by (depth, digest) to nodes; a node belongs to its smallest member,
along whose path it is exploded to its ancestors, to which it adds its part of the sums. That explosion is in blocks as well: to the
ancestors in the node's own block, from the tops of blocks to the tops above, and from a top to the block above it, so a node costs ``BLOCK`` rows and not its depth.
Only leaves and nodes that are shared by several conversations have something to add.

Defined cases: null roles and texts are empty; rows without a conversation take no part; turns are ordered by turn, null first, and equal turns by the
SHA-256 of their role and text, so repeated rows are turns of their own and interchangeable; a table without conversations gives no nodes, not even the root; extra columns are ignored; texts are read
whole and only their digests are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflux.llm.common import arrow, discard, materialize, numbered, words

#: Turns of a block of digests, and ids of a piece of a list that is hashed.
BLOCK, LIST_PIECE = 64, 1024
#: Rebuilt conversations borrow fewer than ``BORROW`` first turns, from the first of ``FAMILY`` ids.
BORROW, FAMILY = 4, 20


def _none() -> Column:
    """The digest of no turns."""
    return F.lit(bytearray())


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), turn_hash, n_words of every turn. Turns are numbered by ranges of the order, so no conversation is one task's."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The role's length keeps role and text apart.
    digest = _sha(*[x.cast("binary") for x in (F.octet_length(role).cast("string"), F.lit(":"), role, text)])
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("turn_hash"), F.size(words(text)).cast("long").alias("n_words")
    )
    ranked = numbered(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_hash")])
    first = ranked.groupBy("conv_id").agg(F.min("number").alias("first"))
    out = materialize(ranked.join(first, "conv_id").select("conv_id", (F.col("number") - F.col("first") + 1).alias("depth"), "turn_hash", "n_words"), "turns")
    discard(ranked)
    return out


def lend_first_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns, and conv_id of every conversation: each has the first turns of its family's first id in place of as many of its own."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROW
    own = turns.groupBy("conv_id").agg(F.max("depth").alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY})
    own = materialize(own, "conversations")
    convs = own.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = turns.where(F.col("depth") < BORROW).withColumnRenamed("conv_id", "base")
    cols = ["conv_id", "depth", "turn_hash", "n_words"]
    borrowed = convs.where("h > 0").join(heads, "base").where("depth <= h").select(*cols)
    kept = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("lent"))
    return borrowed.union(kept.select(*cols)), own.select("conv_id")


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, block, digests of the block's prefixes, words of their last turns, before (digest of the last prefix before the block)."""
    block = F.expr(f"(depth - 1) div {BLOCK}")
    items = F.sort_array(F.collect_list(F.struct("depth", "turn_hash", "n_words")))
    chained = F.aggregate(
        "items", F.array().cast("array<binary>"), lambda done, x: F.array_append(done, _sha(F.coalesce(F.get(done, F.size(done) - 1), _none()), x["turn_hash"]))
    )
    local = turns.groupBy("conv_id", block.alias("block")).agg(items.alias("items"))
    local = materialize(local.select("conv_id", "block", chained.alias("local"), F.transform("items", lambda x: x["n_words"]).alias("n_words")), "paths")
    if not local.where("block > 0").take(1):
        return local.select("conv_id", "block", F.col("local").alias("digests"), "n_words", _none().alias("before"))
    totals = local.select("conv_id", (F.col("block") + 1).alias("depth"), F.element_at("local", -1).alias("turn_hash"), F.lit(0).cast("long").alias("n_words"))
    upper = prefixes(paths(totals)).select("conv_id", F.col("depth").alias("block"), F.col("digest").alias("before"))
    joined = local.join(upper, ["conv_id", "block"], "left")
    digests = F.when(F.col("block") == 0, F.col("local")).otherwise(F.transform("local", lambda x: _sha(F.col("before"), x)))
    out = materialize(joined.select("conv_id", "block", digests.alias("digests"), "n_words"), "paths")
    discard(local)
    last = out.select("conv_id", (F.col("block") + 1).alias("block"), F.element_at("digests", -1).alias("before"))
    return out.join(last, ["conv_id", "block"], "left").withColumn("before", F.coalesce("before", _none()))


def prefixes(found: DataFrame) -> DataFrame:
    """conv_id, depth, digest, parent digest and words of the last turn, of every prefix of every conversation."""
    rows = found.select("conv_id", "block", "digests", "before", "n_words", F.posexplode("digests").alias("i", "digest"))
    parent = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("digests", F.col("i") - 1))
    return rows.select("conv_id", (F.col("block") * BLOCK + F.col("i") + 1).alias("depth"), "digest", parent.alias("parent"), F.get("n_words", F.col("i")).alias("n_words"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("depth", "digest").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))


def _to_ancestors(rows: DataFrame, found: DataFrame, upto: Column) -> DataFrame:
    """Every row (conv_id, block, saved, leaf) once for each of the first ``upto`` prefixes of its conversation's block."""
    rows = rows.join(found.select("conv_id", "block", "digests"), ["conv_id", "block"])
    rows = rows.select("block", "saved", "leaf", F.posexplode(F.slice("digests", 1, upto)).alias("i", "digest"))
    return _summed(rows.withColumn("depth", F.col("block") * BLOCK + F.col("i") + 1))


def subtree_sums(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """depth, digest, saved and leaf, summed over each node's subtree."""
    giving = nodes.where("saved > 0 or leaf > 0").select("conv_id", "depth", F.expr(f"(depth - 1) div {BLOCK}").alias("block"), "saved", "leaf")
    inside = _to_ancestors(giving, found, ((F.col("depth") - 1) % BLOCK + 1).cast("int"))
    if not found.where("block > 0").take(1):
        return inside
    inside = materialize(inside, "inside-blocks")
    owner = nodes.select("depth", "digest", "conv_id")
    top = lambda rows: rows.where(F.col("depth") > 1).where(F.col("depth") % BLOCK == 1).join(owner, ["depth", "digest"]).select("conv_id", F.expr(f"(depth - 1) div {BLOCK}").alias("block"), "saved", "leaf")
    tops = found.where("block > 0").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", F.get("digests", F.lit(0)).alias("digest")))).alias("tops"))
    above = top(inside).join(tops, "conv_id").select("saved", "leaf", F.explode(F.expr("slice(tops, 1, cast(block as int))")).alias("top"))
    above = _summed(above.select("saved", "leaf", "top.digest", (F.col("top.block") * BLOCK + 1).alias("depth")))
    below = _to_ancestors(top(above).withColumn("block", F.col("block") - 1), found, F.lit(BLOCK))
    return _summed(inside.union(below.select(*inside.columns)))


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    schema = pa.schema([("depth", pa.int64()), ("digest", pa.binary()), ("ends_sha256", pa.string())])
    one = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.binary()), pa.array([digest.hexdigest()])], schema=schema)
    for batch in batches:
        for depth, node, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key == (depth, node):
                digest.update(b",")
            else:
                if key:
                    yield one()
                key, digest = (depth, node), hashlib.sha256()
            digest.update(piece.encode())
    if key:
        yield one()


def list_digests(ends: DataFrame) -> DataFrame:
    """depth, digest, SHA-256 of the sorted, comma-joined ids of each node.

    The ids are sorted by ranges and joined in pieces; a node's pieces, of about ``LIST_PIECE`` ids a row, then pass through one running hash, which SHA-256 asks for.
    """
    ranked = numbered(ends, [F.col("depth"), F.col("digest"), F.col("conv_id")])
    first = ranked.groupBy("depth", "digest").agg(F.min("number").alias("first"))
    pieces = ranked.join(first, ["depth", "digest"]).groupBy("depth", "digest", F.expr(f"(number - first) div {LIST_PIECE}").alias("piece"))
    pieces = pieces.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "piece").select("depth", "digest", "ids")
    out = materialize(arrow(dealt, _list_digests, "depth long, digest binary, ends_sha256 string"), "ends")
    discard(ranked)
    return out


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, depth, turn_hash, n_words); ``convs`` also has conversations without turns."""
    found = paths(turns)
    nodes = prefixes(found).groupBy("depth", "digest").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.min("n_words").alias("n_words")
    )
    nodes = materialize(nodes, "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, ["depth", "digest"], "left").withColumns(
        {"saved": (F.col("n_convs") - 1) * F.col("n_words"), "leaf": F.col("n_children").isNull().cast("long"), "n_children": F.coalesce("n_children", F.lit(0))}
    )
    full = materialize(full, "nodes")
    last = F.max(F.struct("block", F.size("digests").alias("n"), F.element_at("digests", -1).alias("digest"))).alias("last")
    ends = convs.join(found.groupBy("conv_id").agg(last), "conv_id", "left").select(
        F.coalesce(F.col("last.block") * BLOCK + F.col("last.n"), F.lit(0)).cast("long").alias("depth"), F.coalesce("last.digest", _none()).alias("digest"), "conv_id"
    )
    ends = list_digests(ends)
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    sums = full.join(subtree_sums(full, found).withColumnsRenamed({"saved": "saved_tokens", "leaf": "n_leaves"}), ["depth", "digest"])
    # One row each.
    members = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    totals = full.agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.sum((F.col("depth") == 1).cast("long")).alias("n_children"))
    root = members.crossJoin(F.broadcast(totals)).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), _none().alias("digest"), F.lit(None).cast("long").alias("parent_conv_id"), "conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
    )
    below = sums.join(parents, ["depth", "parent"], "left").crossJoin(F.broadcast(members.select(F.col("conv_id").alias("_root"))))
    below = below.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_root")).select(*root.columns)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = below.union(root).join(ends, ["depth", "digest"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"), F.hex("digest").alias("digest")
    )


def op13(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns = ordered_turns(conversations)
    rebuilt, convs = lend_first_turns(turns)
    out = trie(materialize(rebuilt, "rebuilt"), convs)
    return out.drop("digest")
