"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document. The ledger keeps its measurements
and one integer whose bit k says that rule k failed. A policy is a version name
and a mask: a document is kept where failures & mask is 0, so a policy can be
changed, compared and ablated from the ledger alone, without a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bound, table, whole

#: name -> failing condition over the measurements. The place in this list is the bit; append only, so that old ledgers stay valid.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 5 * n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("shouting", "2 * n_upper > n_letters"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versioned policies; 1 holds the base rules only.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["duplicate_lines"], 3: (1 << len(RULES)) - 1}
CURRENT = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, counted by sorting the windows' hashes: n log n in the length of a text."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(at):
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s):
        same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

    def slow(w):
        return bound(bound(F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), repeated), covered)

    some = bound(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), slow(w)).otherwise(F.lit(0)))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def measure(docs: DataFrame) -> DataFrame:
    """docs with the columns of MEASURES (long). Null text counts as empty: all are 0."""
    text = whole("text")
    only = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", ""))
    kept = docs.drop(*MEASURES, "_words", "_lines")
    split = kept.withColumn("_words", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    values = {
        "n_words": F.size("_words"),
        "word_chars": only(r"\x21-\x{10FFFF}\x00-\x08\x0E-\x1F"),
        "n_symbols": only("#*$%&|<>"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": bound(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), _repeat_words),  # bound: a filter that is pushed down must not repeat the split for each word
        "n_lines": F.size("_lines"),
        "n_upper": only(r"\p{Lu}"),
        "n_letters": only(r"\p{L}"),
    }
    return split.select(*kept.columns, *[values[m].cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """docs with the measurements and failures (long): bit k is set if rule k fails.

    Empty and null texts fail few_words only. Repeated rows are judged alike, an empty table gives an empty ledger. Columns of docs
    named like a measurement or failures are replaced; others are kept.
    """
    measured = measure(docs.drop("failures"))
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    return measured.withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(ledgered: DataFrame, version: int = CURRENT) -> DataFrame:
    """ledgered with base_failed and kept under the policy of that version. Reads failures only."""
    fails = lambda mask: F.col("failures").bitwiseAND(F.lit(mask)) != 0
    return ledgered.withColumn("base_failed", fails(BASE)).withColumn("kept", ~fails(BASE | POLICIES[version]))


def ablation(ledgered: DataFrame, version: int = CURRENT) -> DataFrame:
    """One row a rule of the policy: rule, n_failed, n_only (documents that this rule alone drops: what leaving it out would keep).

    One aggregation over distinct bitmasks, of which there are 2 ** rules at most.
    """
    mask = POLICIES[version]
    hit = F.col("failures").bitwiseAND(F.lit(mask))
    masks = ledgered.groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).alias("bit")) for n, _ in RULES if BIT[n] & mask])
    each = masks.select("hit", "n", F.explode(rules).alias("r")).filter(F.col("hit").bitwiseAND(F.col("r.bit")) != 0)
    return each.groupBy("r.rule").agg(F.sum("n").alias("n_failed"), F.coalesce(F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
             length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters
      FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 10 * n_symbols > 5 * n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
             + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_upper > n_letters THEN 32 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
