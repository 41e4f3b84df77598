"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from rasterflux.llm import packing, quality_classifier, quality_rules
from rasterflux.llm.queries import ORACLE_SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    sentence = lambda: " ".join(rng.choices(words, k=rng.randint(6, 14))).capitalize() + "."
    rows = []
    for k in range(120):
        text = "\n".join(" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 9)))
        rows.append((text, f"s{k % 4}" if k % 9 else None))
        for _ in range(k % 3 == 0 and rng.randint(1, 4)):
            copy = text.split(" ")
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((" ".join(copy), f"s{k % 4}"))
    rows += [("#### $$$$ %%% ### " * 20, "s1"), ("BUY NOW!!! " * 40, "s2"), ("too short", "s1"), ("", "s1"), (None, "s1")]
    return [(None if k % 50 == 7 else k // 2 if k % 40 == 1 else k, t, "en", s, len(t or "")) for k, (t, s) in enumerate(rows)]


def near_groups(texts):
    """Groups of rows whose distinct 5-word shingles are linked at 0.8."""
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 80 * (len(a) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "")
    at, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        seen[name] = (sorted(at.collect(), key=key) if name != "packing" else at.collect(), out)
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{len(seen)}")
            at = spark.read.parquet(f"{tmp_path}/{len(seen)}")
            seen[name] = (seen[name][0], sorted(at.collect(), key=key))
    # The classifier: the rows whose score, fitted and computed here, reaches the limit.
    rows, kept = seen["quality classifier"]
    scorer = quality_classifier.fit(docs)
    assert kept == [r for r in rows if scorer.score(r.text) >= quality_classifier.KEEP_FROM] and len(kept) < len(rows)
    # The rules: the rows that the SQL of the first query keeps.
    rows, kept = seen["quality rules"]
    con = duckdb.connect()
    con.sql(f"create view documents as select row_number() over () as doc_id, text from '{tmp_path}/1/*.parquet'")
    good = Counter(t for (t,) in con.sql(f"select text from ({ORACLE_SQL['op1_quality_rules']}) join documents using (doc_id) where kept").fetchall())
    assert Counter(r.text for r in kept) == good and len(kept) < len(rows)
    assert quality_rules.DEFAULT_POLICY.mask == 63
    # Near duplicates: one row of each group, the one with the least id.
    rows, kept = seen["near duplicates"]
    groups = defaultdict(list)
    for r, g in zip(rows, near_groups([r.text for r in rows]), strict=True):
        groups[g].append(r)
    assert len(groups) < len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(min((r.doc_id is None, r.doc_id or 0) for r in g) for g in groups.values())
    assert all(r in rows for r in kept)
    # The mix: whole documents, repeated thrice at most, near the targets.
    rows, kept = seen["source mix"]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t))
    have, took = Counter(), Counter()
    for r in rows:
        have[r.source] += size(r.text)
    for r in kept:
        took[r.source] += size(r.text)
    order = sorted(have, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    level, capped = 0.0, set()
    while True:
        level = (sum(have.values()) - sum(3 * have[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if level * weight[s] > 3 * have[s]}
        if more == capped:
            break
        capped = more
    largest = max(size(r.text) for r in rows)
    assert all(abs(took[s] - min(level * weight[s], 3 * have[s])) <= largest for s in order)
    assert max(Counter(kept).values()) <= 3 * max(Counter(rows).values())
    # Packing: every id of every document, once.
    rows, out = seen["packing"]
    tok = packing.tokenizer(packing.default_tokenizer_path())
    want = Counter(tok.ids(r.text) + np.array([2], "<u4").tobytes() for r in rows)
    pieces = defaultdict(list)
    for p in out.collect():
        pieces[p.sequence_id].append(p)
        assert p.length > 0
    assert sum(p.length for ps in pieces.values() for p in ps) == sum(len(k) // 4 * n for k, n in want.items())
    whole = Counter(zlib.crc32(k) for k in want.elements())
    assert all(whole[p.ids_crc32] for ps in pieces.values() for p in ps if p.length == p.doc_tokens)
