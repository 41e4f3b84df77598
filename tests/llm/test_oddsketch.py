"""Near duplicates among rows without ids, and in large groups that share a passage without being similar enough."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rasterflux.llm import oddsketch


def test_rows_without_an_id_are_linked(spark):
    rng = random.Random(5)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(60)]
    changed = lambda w: [*w[:30], "other", *w[31:]]
    p, q, r = text(), text(), text()
    rows = [(None, p), (7, changed(p)), (None, q), (None, changed(q)), (None, r), (9, r), (9, changed(r)), (9, text()), (None, None), (3, None), (None, text())]
    rows = [(i, w and " ".join(w)) for i, w in rows]
    got = oddsketch.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in got)) == sorted(
        [(0, 7, False), (7, 7, True), (0, 0, True), (0, 0, True), (0, 9, False), (9, 9, True), (9, 9, True), (9, 9, True), (0, 0, True), (3, 3, True), (0, 0, True)]
    )


def sharing(n, shared, own, seed=1):
    """Documents that share a passage and end on their own; a few are copies of others but for a word."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(50_000)]
    passage = rng.choices(words, k=shared)
    ends = [rng.choices(words, k=own) for _ in range(n)]
    rows = [(i, " ".join(passage + e)) for i, e in enumerate(ends)]
    twins = [(n + k, " ".join([*passage, *ends[k * 7][:-1], "changed"])) for k in range(20)]
    return rows + twins


@pytest.mark.parametrize("n", [20_000])
def test_pairs_made_stay_few(spark, monkeypatch, n):
    """Similarity about 0.72 of every pair: all pairs would be two hundred million."""
    made = {}
    write = oddsketch.materialize

    def counted(df, name):
        out = write(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(oddsketch, "materialize", counted)
    rows = sharing(n, 53, 10)
    got = {r.doc_id: r.component_id for r in oddsketch.op5(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert {d: c for d, c in got.items() if c != d} == {n + k: k * 7 for k in range(20)}
    # In a round every member of a bucket meets one pivot; the prefixes bring no more than the twins.
    assert made["near-candidates"] < 2 * n and made["near-pivots"] < 30 * n and made["near-prefixes"] < 40 * n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_are_made_once_and_none_is_lost(spark, seed):
    """Members of prefix shingles against all pairs: each that a shared shingle allows is there, and few are made at more than one shingle."""
    rng = random.Random(seed)
    sets = {}
    for node in range(60):
        size = rng.randrange(60, 90)
        # Prefixes in one order, with gaps that differ, as in edited copies.
        prefix = sorted(rng.sample(range(40), rng.randrange(3, 18)))
        sets[node] = (node % 7 if node % 3 else 0, size, {s: size - at for at, s in enumerate(prefix)})
    rows = [(node, comp, size, s, left, 0) for node, (comp, size, prefix) in sets.items() for s, left in prefix.items()]
    open_ = spark.createDataFrame(rows, "node long, comp long, size long, shingle long, left long, major long")

    def allowed(a, b):
        (ca, na, pa), (cb, nb, pb) = sets[a], sets[b]
        early = lambda left, n: 180 * left >= 160 * n
        return ca != cb and any(180 * min(pa[s], pb[s]) >= 80 * (na + nb) and (early(pa[s], na) or early(pb[s], nb)) for s in pa.keys() & pb.keys())

    want = {(a, b) for a in sets for b in range(a) if allowed(a, b)}
    got = [(r.a, r.b) for r in oddsketch._across(open_).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def edited_copies(n, seed):
    """Copies of one text of 400 words with 2 to 18 words changed; no two changes are alike."""
    rng = random.Random(seed)
    text = [f"w{rng.randrange(50_000)}" for _ in range(400)]
    rows = []
    for k in range(n):
        words = list(text)
        for at in rng.sample(range(400), rng.randrange(2, 19)):
            words[at] = f"own{k}x{at}"
        rows.append((k, " ".join(words)))
    return rows


def test_edited_copies_meet_few_centres_and_are_not_paired_with_each_other(spark, monkeypatch):
    """Rows that the joins of prefix shingles make: a member meets some centres, and of pairs too different for a link only few are made. Components are those of all pairs."""
    across, met = [], []
    pairs_of, with_centres = oddsketch._pairs_of, oddsketch._with_centres

    def counted(both, *also):
        rows = both.where("comp_a != comp_b").where(oddsketch._FITS)
        for condition in also:
            rows = rows.where(condition)
        (across if also else met).append(rows.count())
        return pairs_of(both, *also)

    def own(open_, *rest):
        out = with_centres(open_, *rest)
        # At most two centres at each of eight shingles.
        assert met[-1] <= 16 * open_.select("node").distinct().count()
        return out

    monkeypatch.setattr(oddsketch, "_pairs_of", counted)
    monkeypatch.setattr(oddsketch, "_with_centres", own)
    n = 400
    rows = edited_copies(n, 4)
    got = {r.doc_id: r.component_id for r in oddsketch.op5(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = {k: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for k, w in ((k, t.split()) for k, t in rows)}
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert got == {k: find(k) for k in range(n)} and 1 < len(set(got.values())) < n
    # Members meet centres in the first round, hardly any again later, and few pairs follow.
    assert met and sum(met) <= 16 * n and sum(across) <= 2 * n


def test_parities_drop_no_link(spark):
    """Parities differ in at most as many cells as the sets in shingles, whatever their size; pairs of sets that are links are all made."""
    rng = np.random.default_rng(3)
    for size in (1, 5, 60, 900, 20_000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for changed in {0, 1, size // 9, size // 3}:
            b = np.concatenate((a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)))
            ones = np.unpackbits((oddsketch._parities(a, 16) ^ oddsketch._parities(b, 16)).view(np.uint8)).sum()
            assert ones <= 2 * changed
    rows, parities, links = [], [], set()
    for k in range(40):
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        changed = k % 20
        b = np.concatenate((a[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)))
        for node, h in ((2 * k, a), (2 * k + 1, b)):
            rows.append((node, node, 90, k, 90, -1))
            parities.append((node, oddsketch._parities(h, 16).tolist()))
        if 100 * (90 - changed) >= 80 * (90 + changed):
            links.add((2 * k + 1, 2 * k))
    open_ = spark.createDataFrame(rows, "node long, comp long, size long, shingle long, left long, major long")
    got = {(r.a, r.b) for r in oddsketch._across(open_, spark.createDataFrame(parities, "node long, parity array<long>")).collect()}
    assert links and links <= got and len(got) < 40
