"""Information-theoretic sanitisation of personal data.

Four kinds of personal data are found by pattern: these values are the protected entities. A term that stays behind can still reveal one. How strongly it does is estimated from
the corpus: with N documents, n(e) that hold the entity, n(t) that hold the term and n(e, t) in which the term stands within ``REACH`` words of the entity, the pointwise
mutual information log(N n(e, t) / (n(e) n(t))) is compared with the entity's own information log(N / n(e)). A term discloses an entity if it gives at least the share ``DISCLOSURE`` of that
information, seen in at least ``CONTEXTS`` different surroundings (equal surroundings, as in copies, count as one). Disclosing terms are spans wherever they stand, whether or not the
entity stands there too. Where the term's general form (its first ``STEM`` letters and a star, which stands for all terms that start so) discloses nothing, it takes the term's place, else the term is removed.

Counts are over all documents. Terms that may matter are kept in a bitmap of ``BITS`` bits, whatever the corpus, by which each task leaves out the rest before anything is shuffled; the
exact tables decide afterwards by joins. Only the document's own spans are gathered in a group; texts are never shuffled by a search.

Defined cases: a null text is empty and has no spans; terms are runs of letters, marks and digits of at least ``STEM`` code points in lower case, outside what looks like personal data; repeated rows and copies
are documents of their own in the counts; documents without an id are kept; an empty table gives no rows; extra columns are ignored by ``find`` and kept by ``sanitise``; whole texts are read, in linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflux.llm.common import discard, fresh, materialize

REACH, CONTEXTS, DISCLOSURE, STEM = 10, 3, 0.8, 3
BITS = 1 << 20
#: The four kinds, in order. Possessive repeats give the same matches without a stack, and a match can only start where a run does, or where the match before ended.
_MAIL_CHARS = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_MAIL_CHARS})|\G){_MAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to have a match at all.
_SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_LONG_NUMBER = r"[0-9](?:[\x20-]?+[0-9]){15,}+"
LOOKS_PERSONAL = "|".join((PATTERNS["email"], PATTERNS["ip"], PATTERNS["phone"], _LONG_NUMBER))
_LETTER = r"\p{L}\p{M}\p{N}"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def running_sums(values: Column, part: int = 64) -> Column:
    """Sums of an array's values up to each, in steps of ``part`` so that few elements are copied."""
    last = lambda x: F.coalesce(F.get(x, F.size(x) - 1), F.lit(0).cast("long"))
    sums = lambda x: F.aggregate(x, F.array().cast("array<bigint>"), lambda done, v: F.array_append(done, last(done) + v))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(part)), lambda at: sums(F.slice(values, at, F.lit(part))))
    before = lambda x: F.concat(F.array(F.lit(0).cast("long")), sums(F.transform(x, last)))
    return F.flatten(F.zip_with(parts, F.slice(before(parts), 1, F.size(parts)), lambda x, b: F.transform(x, lambda v: v + b)))


def located(df: DataFrame, text: str, patterns: dict[str, str], wanted: dict[str, Column]) -> DataFrame:
    """The table with an array of (start, end, match) for each pattern, in code points, where ``wanted`` holds, else empty.

    The pieces between the matches give the places: a start is the length of all pieces and matches before.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({f"{k}_m": F.when(wanted[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for k, p in patterns.items()})
    lengths = lambda x: F.transform(x, lambda v: F.length(v).cast("long"))
    df = df.withColumns({f"{k}_g": F.when(F.size(f"{k}_m") > 0, lengths(F.split(text, p, -1))).otherwise(F.array().cast("array<bigint>")) for k, p in patterns.items()})
    df = df.withColumns({f"{k}_e": running_sums(F.zip_with(F.slice(f"{k}_g", F.lit(1), F.size(f"{k}_m")), f"{k}_m", lambda g, m: g + F.length(m))) for k in patterns})
    found = {k: F.zip_with(f"{k}_e", f"{k}_m", lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match"))) for k in patterns}
    return df.withColumns(found).drop(*[f"{k}_{x}" for k in patterns for x in "mge"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda s, v: s + v) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    """Whether a match of the kind's pattern is one."""
    digits = _digits(match)
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^(?:{_BYTE}(?:\.|$)){{4}}$"),
        "card": F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def personal_data(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, one array of (start, end, match) per kind, and ``touched``: whether anything in the text looks like personal data."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    holds = lambda sign: F.col("text").contains(sign) if sign else F.col("text").rlike("[0-9]")
    rows = located(rows, "text", PATTERNS, {k: holds(s) for k, s in _SIGN.items()})
    long = F.exists("card", lambda x: F.length(_digits(x["match"])) >= 16)
    rows = rows.withColumn("touched", long | (F.size("email") + F.size("ip") + F.size("phone") > 0))
    valid = lambda kind: lambda x: is_valid(kind, x["match"])
    return rows.withColumns({k: F.filter(k, valid(k)) for k in PATTERNS})


def _terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), rf"[^{_LETTER}]+"), lambda t: F.length(t) >= STEM)


def general_form(term: Column) -> Column:
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


def _with_general(terms: Column) -> Column:
    return F.array_union(terms, F.transform(terms, general_form))


def document_terms() -> Column:
    """Terms of the column ``text``, outside of what looks like personal data."""
    return _terms_of(F.when(F.col("touched"), F.regexp_replace("text", LOOKS_PERSONAL, " ")).otherwise(F.col("text")))


def entity(match: Column) -> Column:
    """The canonical value of what looks like personal data, null where it is not."""
    digits = _digits(match)
    is_ip = match.rlike(r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$")
    return (
        F.when(match.contains("@"), F.concat(F.lit("email:"), F.lower(match)))
        .when(is_ip, F.when(is_valid("ip", match), F.concat(F.lit("ip:"), match)))
        .when(match.startswith("+"), F.when(is_valid("phone", match), F.concat(F.lit("phone:"), digits)))
        .otherwise(F.when(is_valid("card", match), F.concat(F.lit("card:"), digits)))
    )


#: Whether a row holds any personal data.
_HAS_PERSONAL = "touched and size(email) + size(ip) + size(card) + size(phone) > 0"


def surroundings(rows: DataFrame) -> DataFrame:
    """row, entity, terms within reach of the entity in the document (up to the next personal data on either side), sorted."""
    near = rows.where(_HAS_PERSONAL).select("row", "text")
    near = near.withColumns({"hits": F.regexp_extract_all("text", F.lit(LOOKS_PERSONAL), F.lit(0)), "gaps": F.transform(F.split("text", LOOKS_PERSONAL, -1), _terms_of)})
    # Of each gap only the two ends matter.
    near = near.select(
        "row", "hits",
        F.transform("gaps", lambda g: F.slice(g, F.greatest(F.lit(1), F.size(g) - REACH + 1), F.lit(REACH))).alias("before"),
        F.transform("gaps", lambda g: F.slice(g, 1, REACH)).alias("after"),
    )
    after = F.slice("after", F.lit(2), F.greatest(F.size("after") - 1, F.lit(0)))
    both = F.zip_with("hits", F.zip_with(F.slice("before", F.lit(1), F.size("hits")), after, lambda b, a: F.concat(b, a)), lambda h, t: F.struct(entity(h).alias("entity"), t.alias("terms")))
    each = near.select("row", F.explode(both).alias("x")).where("x.entity is not null").select("row", "x.entity", "x.terms")
    return each.groupBy("row", "entity").agg(F.array_sort(_with_general(F.array_distinct(F.flatten(F.collect_list("terms"))))).alias("terms"))


def _bitmap(terms: DataFrame) -> Callable[[Column], Column]:
    """A condition on a term, true for all of ``terms`` and few others. The bitmap has ``BITS`` bits, of which a term sets two, and travels in the plan."""
    places = lambda t: [F.pmod(F.shiftrightunsigned(F.xxhash64(t), k), F.lit(BITS)) for k in (0, 32)]
    longs = terms.select(F.explode(F.array(*places("term"))).alias("place")).groupBy(F.expr("cast(place div 64 as int)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
    # At most BITS / 64 rows.
    bits = {r["at"]: r["bits"] for r in longs.collect()}
    literal = F.split(F.lit(",".join(str(bits.get(k, 0)) for k in range(BITS // 64))), ",").cast("array<bigint>")
    is_set = lambda at: F.getbit(F.get(literal, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
    return lambda t: is_set(places(t)[0]) & is_set(places(t)[1])


def _held(rows: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """term, and the number of rows that hold it, of the terms in ``pairs`` and few others."""
    held = rows.select(F.explode(F.filter(_with_general(document_terms()), _bitmap(pairs))).alias("term"))
    return held.groupBy("term").agg(F.count(F.lit(1)).alias(name))


def disclosing_terms(rows: DataFrame) -> DataFrame:
    """term, general (whether the general form takes its place): the terms that disclose an entity, general forms among them."""
    near = materialize(surroundings(rows), "surroundings")
    n = rows.count()
    holders = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    # Documents of one surrounding, then surroundings: both are summed in the tasks before they are shuffled.
    pairs = near.select("entity", F.xxhash64(F.array_join("terms", " ")).alias("context"), F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= CONTEXTS)
    given = lambda held: F.log(F.lit(float(n)) * F.col("n_et") / (F.col("n_e") * F.col(held)))
    whole = F.log(F.lit(float(n)) / F.col("n_e"))
    discloses = lambda held: (whole > 0) & (given(held) >= DISCLOSURE * whole - 1e-9)
    # At least the documents that hold a term near any entity hold it, then at least those with personal data in which it stands anywhere. Most common words cannot disclose by
    # these counts alone, and are not looked for in all documents.
    least = near.select("row", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_least"))
    pairs = materialize(pairs.join(holders, "entity").join(least, "term").where(discloses("n_least")).drop("n_least"), "disclosure-pairs")
    first = _held(rows.where(_HAS_PERSONAL), pairs, "n_least")
    older, pairs = pairs, materialize(pairs.join(first, "term").where(discloses("n_least")), "disclosure-pairs")
    terms = _held(rows, pairs, "n_t")
    found = pairs.join(terms, "term").where(discloses("n_t")).select("term").distinct()
    found = materialize(found, "disclosing-terms")
    discard(near, older, pairs)
    stems = found.where(F.col("term").endswith("*")).select(F.col("term").alias("stem"), F.lit(True).alias("bad"))
    out = found.where(~F.col("term").endswith("*")).withColumn("stem", general_form(F.col("term"))).join(stems, "stem", "left")
    return out.select("term", ((F.length("term") > STEM) & F.col("bad").isNull()).alias("general"))


def disclosures(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """row, spans: (start, end, term, general) of the disclosing terms in each document that has any, sorted."""
    maybe = _bitmap(terms)
    held = rows.where(F.exists(document_terms(), maybe)).select("row", "text")
    held = located(held, "text", {"word": rf"{LOOKS_PERSONAL}|[{_LETTER}]++"}, {"word": F.lit(True)})
    words = F.transform("word", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lower(x["match"]).alias("term")))
    each = held.select("row", F.explode(F.filter(words, lambda x: maybe(x["term"]))).alias("x")).select("row", "x.*")
    each = each.join(terms, "term").groupBy("row")
    return each.agg(F.sort_array(F.collect_list(F.struct("start", "end", "term", "general"))).alias("terms"))


def _found(docs: DataFrame) -> DataFrame:
    rows = materialize(personal_data(docs), "personal-data")
    terms = materialize(disclosing_terms(rows), "disclosing-terms")
    return rows.join(disclosures(rows, terms), "row", "left")


def find(docs: DataFrame) -> DataFrame:
    """row, doc_id and the spans of each document: one array of (start, end, match) per kind, and terms, of (start, end, term, general)."""
    return _found(docs).select("row", "doc_id", *PATTERNS, "terms")


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with their texts sanitised: personal data replaced by its kind in brackets, disclosing terms by their general form or by nothing."""
    row = fresh(docs, "_row")
    kept = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "sanitised-rows")
    found = _found(kept.select(F.col(row).alias("doc_id"), "text")).drop("row")
    none = "array<struct<start:bigint,end:bigint,new:string>>"
    named = lambda kind: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("new"))
    base = [F.transform(k, named(k)) for k in PATTERNS]
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["general"], general_form(x["term"])).otherwise("").alias("new")))
    spans = F.sort_array(F.concat(*[x.cast(none) for x in base], F.coalesce(terms.cast(none), F.array().cast(none))))
    # Spans that overlap the one before are cut to what is left of them.
    step = lambda done, x: F.struct(
        F.greatest(done["at"], x["end"]).alias("at"),
        F.concat(done["out"], F.substring(done["text"], done["at"] + 1, F.greatest(x["start"] - done["at"], F.lit(0).cast("long"))), F.when(x["end"] > done["at"], x["new"]).otherwise("")).alias("out"),
        done["text"].alias("text"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"), F.col("text").alias("text"))
    text = F.aggregate("spans", start, step, lambda done: F.concat(done["out"], F.substring(done["text"], done["at"] + 1, F.length(done["text"]).cast("long"))))
    new = found.withColumn("spans", spans).select(F.col("doc_id").alias(row), text.alias("text"))
    return kept.drop("text").join(new, row).select(*docs.columns)


def op11(docs: DataFrame) -> DataFrame:
    found = find(docs)
    told = lambda kind: lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))
    base = F.concat(*[F.transform(k, told(k)) for k in PATTERNS])
    terms = F.coalesce(F.transform("terms", told("term")), F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"),
        F.size(terms).cast("long").alias("n_terms"),
    )
