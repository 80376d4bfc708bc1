"""Mixing sources to target weights by capped water-filling.

Targets: every source gets its share of the mix by weight. A source whose share
exceeds `max_epochs` times its own size is clamped there and the excess goes to
the others by weight, until none is above. With sources in order of cap / weight
the clamped ones form a prefix, so one pass over the table of sources finds the
water level.

Sampling: target / size is a number of repetitions. Every document is taken the
whole part of it, and the fractional part is a seeded sample: documents in order
of a keyed digest, up to the one at which their words come closest to the
fraction. The cut is found in a histogram of digest prefixes, and only the bin it
falls into is ordered row by row, so a source with a third of all rows is never
in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, table, whole

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Hex digits of the digest that make a bin of the histogram; 3 give 4096 bins a source.
BIN_DIGITS = 3


def water_fill(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> with target (double). One row a source: the windows here run over the table of sources only.

    Weights go to the sources by code point, null last, and repeat. If all caps together are below the size of the mix, every
    source gets its cap; an empty source gets 0.
    """
    by_name, from_low = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = sources.withColumn("place", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    mix = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))
    before = F.coalesce(F.sum("cap").over(from_low.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(from_low.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (mix - before) / rest)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))
    first = F.min(fits).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = level.withColumn("water", first["level"])
    return out.select("source", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) with size, source_size (long), target (double), repeats and taken (long).

    size: words of the text, null text 0. repeats: how often the mix takes the document; taken = size * repeats. Null sources
    are one source, the last. Rows that are equal in doc_id and text share their digest and are taken alike. An empty table gives
    an empty result. Columns of docs with these names are replaced; others are kept.
    """
    made = ["size", "source_size", "target", "repeats", "taken"]
    docs = docs.drop(*made)
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(whole("text"))))
    size = F.regexp_count(whole("text"), F.lit(WORD)).cast("long")
    keyed = docs.withColumn("size", size).withColumn("_mix_key", digest)
    slim = materialise(keyed.select("source", "size", "_mix_key"), "mix")
    bins = slim.groupBy("source", F.substring("_mix_key", 1, BIN_DIGITS).alias("bin")).agg(F.sum("size").alias("words"))
    bins = materialise(bins, "mix-bins")
    plan = water_fill(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(epochs).cast("long")).withColumn("part", (epochs - F.floor(epochs)) * F.col("source_size"))
    plan = materialise(plan, "mix-plan")

    # The bin in which the fractional words are reached: at most 16 ** BIN_DIGITS rows a source are ordered here.
    run = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    p = plan.withColumnRenamed("source", "_source")
    reached = bins.withColumn("upto", run).join(p, F.col("source").eqNullSafe(F.col("_source"))).filter((F.col("part") > 0) & (F.col("upto") >= F.col("part")))
    cut_bin = reached.groupBy("source").agg(F.min(F.struct("bin", "upto", "words", "part")).alias("b")).select(F.col("source").alias("_s"), "b.*")
    cut_bin = cut_bin.select("_s", "bin", (F.col("upto") - F.col("words")).alias("base"), "part")
    inside = slim.join(cut_bin, F.col("source").eqNullSafe(F.col("_s")) & (F.substring("_mix_key", 1, BIN_DIGITS) == F.col("bin")))
    inside = inside.groupBy("_s", "base", "part", "_mix_key").agg(F.sum("size").alias("words"))
    upto = F.col("base") + F.sum("words").over(Window.partitionBy("_s").orderBy("_mix_key").rowsBetween(Window.unboundedPreceding, 0))
    choice = inside.select("_s", F.struct(F.abs(upto - F.col("part")).alias("off"), upto.alias("upto"), F.col("_mix_key").alias("key")).alias("c"))
    none = cut_bin.select("_s", F.struct(F.abs(F.col("base") - F.col("part")).alias("off"), F.col("base").alias("upto"), F.col("bin").alias("key")).alias("c"))
    cut = choice.unionByName(none).groupBy("_s").agg(F.min("c").alias("c")).select("_s", F.col("c.key").alias("_cut"))
    plan = p.join(cut, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "source_size", "target", "whole", "_cut")
    plan = materialise(plan, "mix-cut")

    repeats = F.col("whole") + F.when(F.col("_mix_key") <= F.col("_cut"), F.lit(1)).otherwise(F.lit(0))
    out = keyed.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    out = out.withColumn("repeats", repeats.cast("long")).withColumn("taken", F.col("size") * F.col("repeats"))
    return out.select(*docs.columns, *made)


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    mixed = mix(docs, **how).filter(F.col("repeats") > 0)
    return mixed.withColumn("_r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*docs.columns)


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "repeats")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, source_size * 2.0::DOUBLE AS cap FROM s),
w AS (SELECT *, ([3.0, 1.0, 2.0])[(place - 1) % 3 + 1]::DOUBLE AS weight FROM r),
q AS (SELECT *, cap / weight AS ratio, (SELECT sum(source_size) FROM s) * 1.5::DOUBLE AS mix FROM w),
l AS (SELECT *, (mix - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q),
f AS (SELECT min_by(level, place + 0) FILTER (level <= ratio AND ratio = (SELECT min(ratio) FROM l WHERE level <= ratio)) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap ELSE least(cap, weight * water) END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, p.source_size, p.target, floor(epochs)::BIGINT AS whole, (epochs - floor(epochs)) * p.source_size AS part,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY k) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
best AS (SELECT source, max(upto) FILTER (upto < part) AS lo, min(upto) FILTER (upto >= part) AS hi, any_value(part) AS part FROM c GROUP BY source),
cut AS (SELECT source, CASE WHEN part <= 0 THEN -1 WHEN hi IS NULL THEN lo WHEN abs(coalesce(lo, 0) - part) <= abs(hi - part) THEN coalesce(lo, 0) ELSE hi END AS words FROM best)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN upto <= words THEN 1 ELSE 0 END) AS taken,
       (whole + CASE WHEN upto <= words AND words > 0 THEN 1 ELSE 0 END) AS repeats
FROM c JOIN cut ON c.source IS NOT DISTINCT FROM cut.source
"""
