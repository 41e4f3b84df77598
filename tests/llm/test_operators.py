"""Operators against brute force, invariants and held-out labels."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterflux.llm import html_extract, lm_scoring, merkle, mixing, oddsketch, packing, quality_classifier, quality_rules, sharding, toxicity
from rasterflux.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    near = lambda x: round(x, 6) if isinstance(x, float) else x
    got = sorted((tuple(near(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(near(r[k]) for k in at) for r in rel.fetchall()), key=repr)


def test_repeated_windows_by_hand(spark):
    text = "a b c d e f g h X a b c d e f g h Y"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert quality_rules.measure(df).first()["n_repeat_words"] == 16


def test_ablations(spark, docs):
    led = quality_rules.ledger(docs)
    bits = [r.fail_bits for r in led.collect()]
    for r in quality_rules.ablations(led).collect():
        bit = quality_rules.BIT[r.rule]
        assert (r.n_failed, r.n_only) == (sum(bool(b & bit) for b in bits), sum(b == bit for b in bits))


def test_shards_hold_the_mixture(spark, docs):
    rows = sharding.interleave(docs, 8).collect()
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values()) <= 1 and len(n) == 8
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    per = Counter((r.shard, r.stratum) for r in rows)
    whole = Counter(r.stratum for r in rows)
    # A contiguous cut of fractional ranks misses a source's share by less than two rows.
    assert all(abs(per[s, k] - whole[k] / 8) < 2.5 for s in n for k in whole)


def test_mix_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a", "b", "c", None]) if i > 3 else "tiny") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op3(df).collect()
    again = {(r.doc_id, r.taken) for r in mixing.op3(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    source = {r[0]: r[2] for r in rows}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    level = {s: target[s] / (k % 3 + 1) for k, s in enumerate(order)}
    free = [s for s in order if target[s] < 3 * size[s] - 1e-6]
    assert len({round(level[s], 6) for s in free}) == 1
    assert all(level[s] <= level[free[0]] + 1e-6 for s in order)
    assert all(abs(taken[s] - target[s]) <= 60 for s in order)


def test_fingerprints_locate_edits(spark):
    lines = [f"Line {k} has its own words. And a second sentence {k}." for k in range(60)]
    edited = lines.copy()
    edited[30] = "Something else."
    df = spark.createDataFrame([(2, "\n".join(lines)), (1, "\n".join(edited)), (0, "\n".join(lines))], "doc_id long, text string")
    got = {r.doc_id: r for r in merkle.op4(df).collect()}
    assert got[2].fingerprint == got[0].fingerprint != got[1].fingerprint
    assert got[2].near_next > 0.95 and got[0].near_next == 1.0
    assert 0.3 < got[2].near_edited < 1


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        out[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    return out


def brute_components(rows):
    sets = shingle_sets(rows)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}, {d: len(s) for d, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 10)):
            copy = base.copy()
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "a b"), (len(rows) + 3, "A  b\n")]
    want, sizes = brute_components(rows)
    got = oddsketch.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes


def test_sketch_estimates():
    hs = oddsketch.hasher()
    rng = np.random.default_rng(1)
    over = lambda a, b: int(np.unpackbits((a ^ b).view(np.uint8)).sum())
    for _ in range(30):
        h = np.unique(rng.integers(0, 1 << 63, 450, dtype=np.uint64))
        a, b = h[:405], h[45:]  # similarity 0.8
        assert over(hs.sketch(hs.samples(a)), hs.sketch(hs.samples(b))) <= oddsketch.MOST_DIFFERING
        far = np.unique(rng.integers(0, 1 << 63, 405, dtype=np.uint64))
        assert over(hs.sketch(hs.samples(a)), hs.sketch(hs.samples(far))) > oddsketch.MOST_DIFFERING


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in oddsketch.connected(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer_path())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = packing.op9(docs).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.array(whole.encode(texts[d], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    total = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 4032 <= at <= 4096 or at & (at - 1) == 0
        assert len(pieces) <= 16
        total += at
    # At most one bin a task is cut into powers of two, and one in a hundred others.
    assert len(by_seq) <= 1.02 * total / 4096 + 24


def test_packing_obeys_three_limits():
    rng = random.Random(1)
    limits = packing.Limits(tokens=100, segments=5, loss_tokens=40)
    items = []
    for k in range(80):
        n = rng.randint(1, 90)
        whole = packing.Piece(k, b"", 0, n, rng.randint(0, n))
        items += list(packing.cut_long(whole, limits))
    want = Counter(p.doc for p in items for _ in range(p.end - p.start))
    bins = packing.pack(items, limits)
    for b in bins:
        assert sum(p.end - p.start for p in b) <= 100 and len(b) <= 5 and sum(p.loss() for p in b) <= 40
    assert Counter(p.doc for b in bins for p in b for _ in range(p.end - p.start)) == want


PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div id="content"><h2>Title &amp; more</h2><p>One,  two,\n three &eacute;.<p>Four <b>five</b><br>six<ul><li>item</ul><aside>side</aside><form>send</form><p>Last one, with a comma.</div>
<div id="comments"><p>A reader says, hi</p></div><footer>&copy; us</footer></body></html>"""


def test_extraction():
    assert html_extract.extract(PAGE) == "Title & more\nOne, two, three é.\nFour five six\nitem\nLast one, with a comma."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p>") == ""
    assert html_extract.extract("just text") == "just text"
    assert html_extract.extract("<article><p>cut &am") == "cut &am"
    assert html_extract.extract("<article><script>a</article>") == ""


LONG = "Words of a paragraph that goes on, and on, with commas, until it is long enough to be read. "
PAGES = {
    # The best container wins over teasers in articles of their own.
    f"<body><main><article><a href=x>Teaser one</a></article><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div></main></body>": ["Title", LONG.strip(), LONG.strip()],
    # The common container of several sections.
    f"<body><nav><a>x</a></nav><div><section><p>{LONG}<p>B.</section><section><p>{LONG}<p>D.</section></div></body>": [LONG.strip(), "B.", LONG.strip(), "D."],
    # A doubtful class inside the article that reads like prose stays, lists of links go.
    f'<article><p>{LONG}</p><div class="related-work"><p>It was done before, by others.</p></div><div class="related-posts"><a>One</a> <a>Two</a></div><ul class="share-this"><li><a>Mail</a></ul></article>': [
        LONG.strip(),
        "It was done before, by others.",
    ],
    # Blocks three levels down; a heading beside the best container.
    f"<body><div id=page><h1>Head</h1><div><div><div><p>{LONG}</p><p>{LONG}</p><blockquote>Said, and done.</blockquote></div></div></div></div></body>": ["Head", LONG.strip(), LONG.strip(), "Said, and done."],
    # Tables, lists and preformatted text of the article.
    f"<article><p>{LONG}</p><table><tr><td>a<td>b<tr><td>c</table><ol><li>one<li>two</ol><pre>x  y</pre></article>": [LONG.strip(), "a", "b", "c", "one", "two", "x y"],
    # What is hidden or asks for consent goes.
    f'<article><p>{LONG}</p><p hidden>no</p><div role="dialog">no, no</div><div class="cookie-notice">We use cookies, and more.</div><p style="display: none">no</p></article>': [LONG.strip()],
}


@pytest.mark.parametrize("page", PAGES)
def test_articles(page):
    assert html_extract.extract(page).split("\n") == PAGES[page]


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    assert html_extract.extract("<div>" * 20_000 + "<p>Hello, there." * 200 + "</x>" * 20_000).count("\n") == 199
    assert time.time() - began < 5


def test_extraction_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for p in html_extract.extract_pages(pages).collect():
        assert p.n_chars == len(p.text) > 0 and "track(" not in p.text


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.sample(docs, labels))
    true = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score_documents(docs, model).collect() if r.doc_id in true]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, plain = ([r.score for r in held if true[r.doc_id] == v] for v in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in plain]) > 0.9
    assert np.mean([s >= 0.7 for s in toxic]) > 0.5 and np.mean([s >= 0.7 for s in plain]) < 0.015
    # The scores of the tasks are those of the formula.
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 50 = 1").collect()}
    model.prepare()
    got = {r.doc_id: r.score for r in rows}
    assert all(got[d] == model.score(t or "") for d, t in texts.items() if d in got)


def test_labels_of_the_other_fold_change_nothing(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.sample(docs, labels) == toxicity.sample(docs, flipped)


def spark_hash(*values) -> int:
    """xxhash64 as Spark chains it over columns; None is skipped."""
    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(v[1], "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
    return h


def test_shards_against_brute_force(spark, docs):
    seed, shards = 17, 16
    rows = [(r.doc_id, "" if r.source is None else "=" + r.source, (r.text or "").encode()) for r in docs.collect()]
    unit = lambda *x: (spark_hash(*x) >> 12) / 2**52
    strata = defaultdict(list)
    for d, s, data in rows:
        crc = zlib.crc32(data)
        strata[s].append((unit((seed, 4), (d, 8), (crc, 8)), d, crc, len(data) + 1))
    order = []
    for s, members in strata.items():
        start = unit((seed + 1, 4), s)
        for rank, (_, d, crc, size) in enumerate(sorted(members)):
            order.append(((rank + start) / len(members), s, d, crc, size))
    order.sort()
    n = len(order)
    want = {}
    for k, (_, _, d, crc, size) in enumerate(order):
        shard = k * shards // n
        want[d] = (size, crc, "rows", shard, k - -(-shard * n // shards), None)
    got = {r.doc_id: (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in sharding.op6(docs).collect()}
    assert got == want


def test_sources_of_one_row_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("host"), "id").alias("source"))
    starts = [unit for unit in (((spark_hash((18, 4), f"=host{k}")) >> 12) / 2**52 for k in range(3000))]
    assert max(Counter(int(x * 10) for x in starts).values()) < 400
    n = Counter(r.shard for r in sharding.op6(df).collect())
    assert len(n) == 16 and max(n.values()) - min(n.values()) <= 1


def test_quality_scores_are_those_of_the_formula(spark, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    votes = Counter(quality_classifier.pattern(quality_classifier.votes(quality_classifier.facts(t))) for t in texts.values())
    codes = np.array(sorted(votes.items()), np.int64)
    model = quality_classifier.expectation_maximisation(quality_classifier.unpattern(codes[:, 0]), codes[:, 1].astype(float))
    np.testing.assert_allclose(quality_classifier.label_model(docs).tables, model.tables)
    scorer = quality_classifier.fit(docs)
    assert (quality_classifier.fit(docs.repartition(5)).weights == scorer.weights).all()
    assert {r.doc_id: r.score for r in quality_classifier.op8(docs).collect()} == {d: scorer.score(t) for d, t in texts.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_hot_buckets(spark, hot, monkeypatch):
    """Salted buckets, and prefixes of the sets in those that pivots have not settled, lose no link."""
    monkeypatch.setattr(oddsketch, "LEAST_HOT", 5)
    if hot:
        monkeypatch.setattr(oddsketch, "ROUNDS", 0)
    rng = random.Random(21)
    words = [f"w{k}" for k in range(2000)]
    shared = rng.choices(words, k=70)
    rows = []
    for k in range(60):
        # A passage that all share, and ends that make some near copies of others.
        own = rng.choices(words, k=40) if k % 3 == 0 else list(rows[-1][1][70:])
        for _ in range(k % 3 and rng.randint(0, 3)):
            own[rng.randrange(40)] = rng.choice(words)
        rows.append((k, [*shared, *own]))
    rows = [(k, " ".join(w)) for k, w in rows]
    want, _ = brute_components(rows)
    got = oddsketch.op5(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_label_model_finds_the_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    v = np.full((4000, 9), quality_classifier.NONE)
    for k in range(9):
        right = rng.random(4000) < (0.99 if k < 5 else 0.9)
        v[:, k] = np.where(rng.random(4000) < 0.3, quality_classifier.NONE, np.where(good == right, quality_classifier.GOOD, quality_classifier.JUNK))
    model = quality_classifier.expectation_maximisation(v, np.ones(4000))
    assert abs(model.good - 0.8) < 0.03
    assert abs(model.tables[1, 0, quality_classifier.GOOD] - 0.99) < 0.02 and abs(model.tables[1, 8, quality_classifier.GOOD] - 0.9) < 0.03


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality_classifier.op8(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in true]
    kept = {v: np.mean([r.kept for r in rows if true[r.doc_id] == v]) for v in (0, 1)}
    assert kept[1] > 0.98 and kept[0] < 0.1


def brute_scores(texts, targets):
    """Per text its cross-entropies under background and target, and their difference, from the formula of the model."""
    sides = []
    for part in (texts, [texts[k] for k in targets] or texts):
        uni, bi = Counter(), Counter()
        for text in part:
            w = (text or "").lower().split()
            uni.update(w), bi.update(zip(w, w[1:]))
        sides.append((uni, bi, sum(uni.values())))
    size = len(sides[0][0]) + 1
    out = []
    for text in texts:
        w = (text or "").lower().split()
        row = []
        for uni, bi, total in sides:
            p = lambda x: (uni[x] + 0.5) / (total + 0.5 * size)  # noqa: B023, E731
            logs = [np.log(p(x)) for x in w[:1]] + [np.log((bi[a, b] + 5 * p(b)) / (uni[a] + 5)) for a, b in zip(w, w[1:])]
            row.append(-sum(logs) / len(w) if w else 0.0)
        out.append((*row, row[0] - row[1]))
    return out


def check_scores(spark, texts, targets, block):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    ids = spark.createDataFrame([(k,) for k in targets], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score_documents(df, ids, block).collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(brute_scores(texts, targets)):
        r = got[k]
        np.testing.assert_allclose((r.background, r.target, r.score), want, rtol=2e-6, atol=2e-6)


@pytest.mark.parametrize("block", [None, 300, 5000])
@pytest.mark.parametrize("targets", [list(range(0, 40, 3)), []])
def test_scores_against_brute_force(spark, block, targets, monkeypatch):
    rng = random.Random(7)
    # A small head, so that most words and bigrams meet by key.
    monkeypatch.setattr(lm_scoring, "BIGRAMS", 6)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(6000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)] + [None, "", "  ", "w1", "only once here", words[0]]
    check_scores(spark, texts + texts[:5], targets, block)


def test_scores_with_more_words_than_the_head_holds(spark):
    rng = random.Random(3)
    texts = [" ".join(w for k in range(1000) for w in (f"w{d * 900 + k}", rng.choice(("x", "y", "z")))) for d in range(80)]
    assert len({w for t in texts for w in t.split()}) > lm_scoring.VOCABULARY
    check_scores(spark, texts, list(range(9)), 20_000)


def test_only_near_copies_are_dropped_at_every_size():
    rng = random.Random(4)
    docs = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=3000)).encode() for _ in range(2000)]
    copies = [docs[0][:1500] + b"?" + docs[0][1500:], docs[7].replace(b"ab", b"ba"), docs[9]]
    assert toxicity.distinct_documents([*docs, *copies]) == docs
    assert toxicity.distinct_documents([b"", b"short", b"", b"some other", b"some other"]) == [b"", b"short", b"", b"some other"]


@pytest.mark.parametrize(
    ("samples", "longs", "limit", "deviations"),
    [(oddsketch.SAMPLES, oddsketch.SKETCH_LONGS, oddsketch.MOST_DIFFERING, 5)],
)
def test_sketch_limits_are_as_many_deviations_as_stated(samples, longs, limit, deviations):
    rng = np.random.default_rng(8)
    # At similarity 0.8 a fifth of the samples differ, and each that does sets a bit in either sketch.
    ones = []
    for differing in rng.binomial(samples, 0.2, 20_000):
        ones.append((np.bincount(rng.integers(0, 64 * longs, 2 * differing)) & 1).sum())
    assert limit > np.mean(ones) + (deviations - 0.1) * np.std(ones)


def test_stage_compares_five_words(spark):
    words = [f"w{k}" for k in range(100)]
    # Two words changed: similarities 89/105 of four words, 86/106 of five.
    less = [*words[:20], "x", *words[21:60], "y", *words[61:]]
    # And one near the start: 87/107 of four words reach the limit, 84/108 of five do not.
    more = [*less[:1], "z", *less[2:]]
    for texts, four, five in ((less, True, True), (more, True, False)):
        df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(texts))], "doc_id long, text string")
        assert (oddsketch.keep_one(df, 4).count() == 1) == four
        assert (oddsketch.keep_one(df).count() == 1) == five
