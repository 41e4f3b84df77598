"""The prefix trie against a brute force over dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rasterflux.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, digest string, block long, saved long"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        gain = (len(m) - 1) * len([w for w in (p[-1][1] if p else "").replace("\n", " ").split(" ") if w])
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            leaves[p[:d]] += not kids[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    full = [(*r, 1, "x", 2, 3) for r in rows]
    got = prefix_trie.op13(spark.createDataFrame(full, SCHEMA)).collect()
    return sorted((tuple(r[k] for k in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in got), key=repr)


def conversations(n, long, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        path = [(rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e\nf", "", None])) for _ in range(rng.randint(1, 4))]
        if c % 3 == 0:
            path = [("user", "same start"), ("assistant", "same answer here")] + path
        if c in (5, 7, 45):
            path = [("user", f"long {k}") for k in range(long + c % 2)]
        rows += [(c, t, *x) for t, x in enumerate(path)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, long", [(64, 150), (3, 40)])
def test_equals_brute_force(spark, monkeypatch, block, long):
    # With blocks of three turns, forty turns take four levels of digests.
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = conversations(60, long, block)
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "user", "x")]) == []
    rows = [
        (-3, 0, "user", "negative"), (1, None, None, None), (1, 0, "user", "x " * 50_000), (1, 0, "user", "x " * 50_000), (1, 0, "user", "y"),
        (21, 0, None, "short"), (22, 5, "user", ""), (22, 5, "use", "r"), (23, 1, "a", "b"), (20, 1, "a", "b"), (2**62, 0, "user", "huge"),
    ]
    assert found(spark, rows) == brute(rows)


def test_lists_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LIST_PIECE", 4)
    rows = [(c * 20, 0, "user", "one and the same") for c in range(50)]
    assert found(spark, rows) == brute(rows)
