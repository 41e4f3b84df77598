"""Rule bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule; versioned
policies are bit masks over it. ``stored`` writes it, without texts, so that a policy change or an ablation reads the ledger only; ``filter_documents``
applies one policy and carries the documents through the same pass instead.

Defined cases: a null or empty text has no words, all measurements 0, and fails rule ``few_words``. Repeated rows each get
their own ledger row. Extra columns of the input are ignored. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterflux.llm.common import materialize, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a window whose repetition is counted.
WINDOW = 8


def _rules() -> dict[str, Column]:
    """Rule name -> failure condition over the measurements; the position is the bit and never changes."""
    c = F.col
    return {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 20 * c("n_symbols") > c("word_chars"),
        "repeated_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "upper_case": 2 * c("n_upper") > c("word_chars"),
        "long_words": c("word_chars") > 20 * c("n_words"),
    }


RULES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "upper_case", "long_words")
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


POLICIES = {
    "base-1": Policy("base-1", ("few_words", "repeated_windows")),
    "web-1": Policy("web-1", RULES),
}
DEFAULT_POLICY = POLICIES["web-1"]


def _covered(grams: Column) -> Column:
    """Number of words inside windows whose hash occurs twice or more."""
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        twice = F.filter(p, lambda s, k: (s["h"] == F.get(p, k - 1)["h"]) | (s["h"] == F.get(p, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda s: s["i"]))

    def count(p: Column) -> Column:
        steps = F.transform(p, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # transform over a one-element array binds a value once, as a "let".
    return F.transform(F.array(F.transform(F.array(placed), starts)[0]), count)[0].cast("long")


def measure(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the columns to carry and the measurements of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0)
    df = docs.select("doc_id", *carry, text.alias("_t"), words(F.col("text")).alias("_w"), has_word.alias("_l"))
    df = df.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    gram = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.slice("_h", F.lit(1), F.size("_h") - (WINDOW - 1)),
            lambda x, i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", gram)
    return df.select(
        "doc_id",
        *carry,
        "n_words",
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0).cast("long"))
        .otherwise(_covered(F.col("_g")))
        .alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, *carry: str) -> DataFrame:
    """Measurements and ``fail_bits`` (bit k set: rule k failed)."""
    bits = [F.when(cond, F.lit(BIT[name])).otherwise(F.lit(0)) for name, cond in _rules().items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, *carry).withColumn("fail_bits", total.cast("long"))


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder: about 80 bytes a document."""
    return materialize(ledger(docs), "ledger")


def apply_policy(led: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Adds ``kept``, ``base_failed`` and ``policy`` from the bits alone."""
    return led.withColumns(
        {
            "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0,
            "kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask | BASE_MASK)) == 0,
            "policy": F.lit(policy.version),
        }
    )


def ablations(led: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Per rule of the policy: documents failing it, failing only it (kept again without it), and rejected in all.

    Documents are first counted per distinct bit pattern, so the rules are expanded over patterns, not documents.
    """
    masked = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    patterns = led.groupBy(masked.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    return (
        patterns.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
            F.bit_or("bits").alias("bits_seen"),
        )
    )


def filter_documents(docs: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """The documents that the policy keeps, with their own columns, carried through the ledger in the same row.

    Rows are dropped by a generator, not a filter: a filter would be pushed below the ledger and repeat every measurement.
    """
    carried = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    judged = apply_policy(ledger(carried, "_row"), policy)
    return judged.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")
