"""Spans of personal data and disclosing terms against a brute force with another regular-expression engine."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
import regex

from rasterflux.llm import sanitise
from rasterflux.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ANY = "|".join((PLAIN["email"], PLAIN["ip"], PLAIN["phone"], r"[0-9](?:[\x20-]?[0-9]){15,}"))


def luhn(d):
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


def valid(kind, m):
    digits = regex.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def entity(m):
    digits = regex.sub("[^0-9]", "", m)
    if "@" in m:
        return "email:" + m.lower()
    kind = "ip" if regex.fullmatch(r"[0-9]+(\.[0-9]+){3}", m) else "phone" if m[0] == "+" else "card"
    return f"{kind}:{m if kind == 'ip' else digits}" if valid(kind, m) else None


def brute(texts):
    """For each text: counts per kind, base spans and term spans."""
    texts = [t or "" for t in texts]
    base = [[(k, m.start(), m.end()) for k, p in PLAIN.items() for m in regex.finditer(p, t) if valid(k, m[0])] for t in texts]
    terms_of = lambda t: [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", t.lower()) if len(w) >= 3]
    general = lambda ws: set(ws) | {w[:3] + "*" for w in ws}
    n_t, n_e, n_et, contexts = Counter(), Counter(), Counter(), defaultdict(set)
    for t, b in zip(texts, base):
        n_t.update(general(terms_of(regex.sub(ANY, " ", t))))
        hits = list(regex.finditer(ANY, t)) if b else []
        cuts = [0, *[x for m in hits for x in m.span()], len(t)]
        gaps = [terms_of(t[cuts[k] : cuts[k + 1]]) for k in range(0, len(cuts), 2)]
        near = defaultdict(set)
        for k, m in enumerate(hits):
            if e := entity(m[0]):
                near[e] |= set(gaps[k][-10:]) | set(gaps[k + 1][:10])
        n_e.update(near.keys())
        for e, ws in near.items():
            for w in general(ws):
                n_et[e, w] += 1
                contexts[e, w].add(frozenset(general(ws)))
    n = len(texts)
    told = set()
    for (e, w), both in n_et.items():
        whole = math.log(n / n_e[e])
        if len(contexts[e, w]) >= 3 and whole > 0 and math.log(n * both / (n_e[e] * n_t[w])) >= 0.8 * whole - 1e-9:
            told.add(w)
    found = [[("term", m.start(), m.end()) for m in regex.finditer(rf"{ANY}|[\p{{L}}\p{{M}}\p{{N}}]+", t) if m[0].lower() in told] for t in texts]
    return base, found, told


def rows_of(texts):
    out = []
    for i, (b, f) in enumerate(zip(*brute(texts)[:2])):
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        counts = Counter(k for k, _, _ in b)
        out.append((i, *[counts[k] for k in PLAIN], hashlib.sha256(said.encode()).hexdigest(), ",".join(x for x in (said, ",".join(f"{k}:{s}:{e}" for k, s, e in f)) if x), len(f)))
    return out


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, row int, terms string, email string")
    return sorted(tuple(r) for r in sanitise.op11(docs).collect())


@pytest.mark.parametrize("table", [SF])
def test_query_equals_brute_force(spark, table):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{table}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_sanitisation"](spark, table).collect()}
    want = {d: r[1:] for (d, _), r in zip(docs, rows_of([t for _, t in docs]))}
    assert got == want and any(r[4] for r in got.values())


def corpus(seed=3):
    """Ann's address stands beside words that occur nowhere else, and beside ordinary ones."""
    rng = random.Random(seed)
    common = [a + b for a in ("gra", "sto", "win", "lam", "tre") for b in ("ss", "ne", "ter", "p", "es")]
    prose = lambda n: " ".join(rng.choice(common) for _ in range(n))
    texts = [prose(rng.randint(5, 60)) for _ in range(120)]
    for _ in range(8):
        texts.append(f"{prose(9)} Stonehelm {prose(2)} ann@mail.example.org {prose(1)} Straussia, {prose(30)}")
    # One surrounding in ten copies is no evidence.
    texts += ["zebulon wrote to bob@mail.example.org about rain"] * 10
    texts += ["Stonehelm alone, without the address. Straws are ordinary: grass stone strap string strong street."] * 2
    return texts


def test_terms_that_disclose(spark):
    texts = corpus()
    told = brute(texts)[2]
    assert {"stonehelm", "straussia"} <= told and "zebulon" not in told
    assert not told & {"grass", "stone", "winter"}
    assert found(spark, texts) == rows_of(texts)


def test_sanitised_texts(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    got = {r.doc_id: r.text for r in sanitise.sanitise(docs).collect()}
    assert len(got) == len(texts)
    # Stems of the one stand for ordinary words as well, the other's stem discloses too.
    assert got[len(texts) - 1] == "sto* alone, without the address. Straws are ordinary: grass stone strap string strong street."
    assert "[EMAIL] " in got[121] and " sto* " in got[121] and "Straussia" not in got[121] and "@" not in got[121]
    assert got[0] == texts[0]


ODD = [
    None, "", " \n\t", "a@b", "a@b.c_d@e.f", "x..y@-.-.", "%@a.b.", "a@b.c@d.e", "@a.b", "é@a.b ü.x@ä.c 文@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.02.003.255 1.2.3", "1.2.3.4@a.b.c",
    "4111 1111 1111 1111", "4111-1111 1111-1111 2", "41111111111111111111111", "+4111 1111 1111 1111", "+1 (487) 555-7209.", "+12", "+1+1 234 567 89", "+1 ( 2 ) ", "+1234567890123456",
    "\U0001f600 a@b.cd \U0001f600 +49 30 1234567", "tel:+49 (30) 123-45-67, 10.0.0.1; mail X.Y@Z.org",
]


def test_edges(spark):
    assert found(spark, ODD) == rows_of(ODD)
    assert found(spark, ODD + ODD) == rows_of(ODD + ODD)
    assert found(spark, []) == []
    docs = spark.createDataFrame([(None, "a@b.cd"), (None, None), (1, "a@b.cd")], "doc_id long, text string")
    assert sorted(r.n_email for r in sanitise.op11(docs).collect()) == [0, 1, 1]
    assert sorted(r.text or "" for r in sanitise.sanitise(docs).collect()) == ["", "[EMAIL]", "[EMAIL]"]


def test_very_long_texts(spark):
    """In linear time, and without a stack for repeated groups."""
    texts = ["x" * 400_000, "a@" + "b." * 100_000 + "c", "1.2.3.4 " * 10_000, "7" * 300_000, "+1" + " " * 300_000, "a@b.cd " * 10_000, "-".join("1" * 200_000)]
    got = found(spark, texts)
    assert [r[1:5] for r in got] == [(0, 0, 0, 0), (1, 0, 0, 0), (0, 10_000, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (10_000, 0, 0, 0), (0, 0, 0, 0)]
    assert got[1][6] == "email:0:200003" and got[5][6].endswith(",email:69993:69999")


def test_common_words_near_entities_are_not_looked_for_in_all_documents(spark, monkeypatch):
    """A word near many entities cannot disclose one; only terms that may are looked for, and the result is the same."""
    other = ["alpha", "beta", "gamma", "delta"]
    rows = [(k, f"common {other[k]} codename x@secret.org") for k in range(4)]
    rows += [(k, f"common word{k} y{k}@open.org") for k in range(4, 34)]
    asked = []
    bitmap = sanitise._bitmap
    monkeypatch.setattr(sanitise, "_bitmap", lambda terms: asked.append({r["term"] for r in terms.collect()}) or bitmap(terms))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r["term"] for r in sanitise.disclosing_terms(sanitise.personal_data(docs)).collect()}
    assert terms == {"codename"}
    assert all(x == {"codename", "cod*"} for x in asked)


def test_words_common_in_documents_with_personal_data_are_not_looked_for_in_all(spark, monkeypatch):
    """A word near one entity only, but common elsewhere in documents with personal data, is dropped before all documents are read."""
    other, far = ["alpha", "beta", "gamma", "delta"], " ".join(f"far{i}" for i in range(12))
    rows = [(k, f"usual {other[k]} codename x@secret.org") for k in range(4)]
    rows += [(k, f"usual {far} word{k} y{k}@open.org") for k in range(4, 34)]
    asked = []
    bitmap = sanitise._bitmap
    monkeypatch.setattr(sanitise, "_bitmap", lambda terms: asked.append({r["term"] for r in terms.collect()}) or bitmap(terms))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r["term"] for r in sanitise.disclosing_terms(sanitise.personal_data(docs)).collect()}
    assert terms == {"codename"}
    assert "usual" in asked[0] and asked[-1] == {"codename", "cod*"}
