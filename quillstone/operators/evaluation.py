"""Evaluation of retrieval and answers: scoring of results that are given as tables, reports, intervals and regressions.

Searching, answering, embedding and judging are hooks outside: their results come as columns, so that a report is one
plan over them and is run as often as wanted without asking anybody again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T

METRICS = [f"{m}_{k}" for k in M.DEPTHS for m in ("hit", "recall", "all", "success")] + ["mrr", "ndcg_10", "raw_success_5", "raw_mrr"]
#: Names of metrics that are better when lower end in these.
LOWER_IS_BETTER = ("error_rate", "mean_seconds", "p95_seconds", "max_seconds", "cost_usd")


def group_by_url(found: DataFrame) -> DataFrame:
    """(query_id, pos, url, score, rerank) -> the best row of each url of a query, by rerank with null as 0, the first of equals, with
    rank: by rerank downwards, urls of equal rerank in the order in which they were first seen. Urls are combined before the shuffle."""
    weight = F.coalesce("rerank", F.lit(0.0))
    best = F.max_by(F.struct("score", "rerank"), F.struct(weight, -F.col("pos"))).alias("b")
    out = found.groupBy("query_id", "url").agg(best, F.min("pos").alias("seen")).select("query_id", "url", "seen", "b.score", "b.rerank")
    order = Window.partitionBy("query_id").orderBy(F.coalesce("rerank", F.lit(0.0)).desc(), "seen")
    return out.withColumn("rank", F.row_number().over(order)).drop("seen")


def evaluate(cases: DataFrame, found: DataFrame, index_urls: DataFrame, threshold: float | None = None, semantic: bool = True) -> DataFrame:
    """One row for each of cases (query_id, answer_type, relevant: map of url to grade, answerable, error: null or a message, and other
    columns, which are kept): status, ranked_urls, top1, n_groups, n_selected, is_confident and the scores of metrics.score_row, with
    raw_success_5 and raw_mrr of the ranking before the threshold.

    found: (query_id, pos, url, score, rerank). A case with a relevant url that index_urls (url) lacks is stale_ground_truth, one with
    an error is error; neither is scored. Groups below the threshold don't count; if none is left, the first one does, unconfidently.
    """
    wanted = cases.select("query_id", F.explode(F.map_keys("relevant")).alias("url"))
    missing = wanted.join(index_urls.select("url").distinct(), "url", "left_anti").groupBy("query_id").agg(F.sort_array(F.collect_list("url")).alias("missing"))
    weight = F.coalesce("rerank", F.lit(0.0))
    strong = F.lit(True) if threshold is None else weight >= threshold
    groups = group_by_url(found).withColumn("strong", strong)
    row = F.struct("rank", "url", "strong", "score", "rerank")
    lists = groups.groupBy("query_id").agg(F.sort_array(F.collect_list(row)).alias("g"))  # as many as a search returns
    out = cases.join(missing, "query_id", "left").join(lists, "query_id", "left").withColumn("g", F.coalesce("g", F.array().cast(lists.schema["g"].dataType)))
    status = F.when(F.col("missing").isNotNull(), "stale_ground_truth").when(F.col("error").isNotNull(), "error").otherwise("ok")
    ok, scored = F.col("status") == "ok", (F.col("status") == "ok") & F.col("answerable")
    kept = F.filter("g", lambda x: x["strong"])
    selected = F.when(F.size(kept) > 0, kept).otherwise(F.slice("g", 1, 1))
    top = F.get("g", F.lit(0))
    top1 = F.coalesce(top["rerank"], top["score"]) if semantic else top["score"]
    out = out.withColumn("status", status).withColumn("_urls", F.transform(selected, lambda x: x["url"])).withColumn("_all", F.transform("g", lambda x: x["url"]))
    out = out.withColumn("is_confident", F.when(ok, F.size(kept) > 0)).withColumn("top1", F.when(ok, top1))
    out = out.withColumn("n_groups", F.when(ok, F.size("g"))).withColumn("n_selected", F.when(ok, F.size("_urls")))
    names = ["first_rel_rank", "mrr", *(f"{m}_{k}" for k in M.DEPTHS for m in ("hit", "recall", "all", "success")), "ndcg_10"]
    scores = M.score_row(F.col("relevant"), F.col("_urls"), F.col("answer_type"))
    raw = {n: c for n, c in zip(names, M.score_row(F.col("relevant"), F.col("_all"), F.col("answer_type")), strict=True)}
    out = out.select("*", *[F.when(scored, c).alias(n) for n, c in zip(names, scores, strict=True)], F.when(scored, raw["success_5"]).alias("raw_success_5"), F.when(scored, raw["mrr"]).alias("raw_mrr"))
    return out.withColumn("ranked_urls", F.when(ok, F.slice("_urls", 1, 10))).drop("g", "_urls", "_all", "strong")


def means(rows: DataFrame, by: list[str] | None = None, names: list[str] = METRICS) -> DataFrame:
    """n and the mean of each metric, of all rows or by keys; null where there is no value."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in names])


def breakdowns(rows: DataFrame, keys: list[str], names: list[str] = METRICS) -> DataFrame:
    """means() for each value of each of keys, one key after another, as (key, value, n, ...): grouping sets of one pass. Null is ""."""
    filled = rows.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], *names)
    sets = filled.groupingSets([[F.col(k)] for k in keys], *keys)
    which = F.coalesce(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    out = sets.agg(which.alias("key"), F.count("*").alias("n"), *[F.avg(m).alias(m) for m in names])
    return out.select("key", F.coalesce(*keys).alias("value"), "n", *names)


def counts(results: DataFrame) -> DataFrame:
    """One row: total, scored_answerable, scored_unanswerable, stale_ground_truth and errors of evaluate()'s results."""
    ok, never = F.col("status") == "ok", F.col("answer_type") == "unanswerable"
    parts = {"scored_answerable": ok & ~never, "scored_unanswerable": ok & never, "stale_ground_truth": F.col("status") == "stale_ground_truth", "errors": F.col("status") == "error"}
    return results.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in parts.items()])


def false_positives(results: DataFrame) -> DataFrame:
    """variant, n and fp_rate: how often a query without an answer was answered confidently."""
    rows = results.filter((F.col("status") == "ok") & (F.col("answer_type") == "unanswerable"))
    return rows.groupBy(F.coalesce("variant", F.lit("unknown")).alias("variant")).agg(F.count("*").alias("n"), F.avg(F.col("is_confident").cast("double")).alias("fp_rate"))


def nearest_rank(value: str, p: float) -> Column:
    """Aggregate: the percentile by nearest rank, the least value that p percent of all don't exceed."""
    return F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})")


def rounded_rank(rows: DataFrame, value: str, share: float = 0.95) -> Column:
    """Aggregate over rows: the value at place round(share * (n - 1)) from 0, halves to even. Rows are counted first."""
    n = rows.filter(F.col(value).isNotNull()).count()
    at = min(n - 1, round(share * (n - 1))) if n else 0
    return F.expr(f"percentile_disc({(at + 0.5) / max(1, n)}) WITHIN GROUP (ORDER BY {value})")


def _poisson(mean: int) -> list[float]:
    """The distribution function of a Poisson variable at 0, 1 and so on, up to where nothing is left."""
    out, p, total, n = [], math.exp(-mean), 0.0, 0
    while total < 1 - 1e-12 and n < 20 * mean + 40:
        total += p
        out.append(total)
        n += 1
        p *= mean / n
    return out


_BASE = 32


def bootstrap(values: DataFrame, value: str, iterations: int = 1000, seed: int = 1) -> DataFrame:
    """One row (low, high): the 95 % interval of the mean by resampling; null with fewer than 2 values or 100 iterations.

    Each resample draws as many values as there are, with replacement, as counts: every occurrence of a value is drawn Poisson(1) times, on its own. Equal
    values are counted first, and the occurrences of one are drawn together, in blocks of 1, 32, 32 ** 2 and so on of them, whose sums are Poisson variables
    of these means (from 32 ** 2 on by their normal limit): some 31 draws for each power, however often a value occurs. The seeded hash of value, block and
    iteration draws, so that reruns agree."""
    x = F.col(value).cast("double")
    counted = values.select(x.alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("n"))
    digits = F.array(*[F.expr(f"named_struct('k', {k}L, 'd', int((n div {k}L) % {_BASE}))") for k in (_BASE**j for j in range(12))])
    blocks = counted.select("x", F.explode(digits).alias("b")).filter("b.d > 0").select("x", "b.k", F.explode(F.sequence(F.lit(1), F.col("b.d"))).alias("j"))
    drawn = blocks.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed + salt), "x", "k", "j", "i"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    table = lambda mean: F.size(F.filter(F.array(*[F.lit(p) for p in _poisson(mean)]), lambda p: p < F.col("u")))
    normal = F.sqrt(-2 * F.log("u")) * F.cos(2 * math.pi * uniform(1_000_003))
    many = F.greatest(F.lit(0.0), F.round(F.col("k") + F.sqrt("k") * normal))
    times = F.when(F.col("k") == 1, table(1)).when(F.col("k") == _BASE, table(_BASE)).otherwise(many)
    drawn = drawn.withColumn("u", uniform(0)).withColumn("t", times.cast("double"))
    drawn = drawn.groupBy("i").agg((F.sum(F.col("x") * F.col("t")) / F.nullif(F.sum("t"), F.lit(0.0))).alias("m"))
    means_ = drawn.agg(F.sort_array(F.collect_list("m")).alias("m"))  # as many as iterations
    enough = F.lit(iterations >= 100) & (F.col("n") >= 2) & (F.size("m") > 0)
    at = lambda share, back: F.get("m", F.greatest(F.lit(0), F.floor(F.size("m") * share).cast("int") - back))
    both = means_.crossJoin(counted.agg(F.sum("n").alias("n")))  # one row each
    return both.select(F.when(enough, at(0.025, 0)).alias("low"), F.when(enough, at(0.975, 1)).alias("high"))


def score_answers(cases: DataFrame, k: int = 5, prices: tuple[float, float] | None = None) -> DataFrame:
    """Every metric of each answered case (expected, answer, citations, relevant, refused, cost_usd, input_tokens, output_tokens, error):
    token_f1, sequence_similarity, answered, retrieval (a struct), refused and cost_usd. A case with an error has no generation scores."""
    clean = T.without_citations(F.col("answer"))
    fine = F.col("error").isNull()
    out = cases.withColumn("token_f1", F.when(fine, F.round(T.token_f1(F.col("expected"), clean), 4)))
    out = out.withColumn("sequence_similarity", F.when(fine, F.round(T.sequence_similarity(F.col("expected"), clean), 4)))
    out = out.withColumn("answered", F.when(fine, T.strip(F.coalesce("answer", F.lit(""))) != ""))
    out = out.withColumn("retrieval", M.score_retrieval(F.col("citations"), F.col("relevant"), k))
    out = out.withColumn("refused", T.refused(F.col("refused"), F.col("answer")))
    return out.withColumn("cost_usd", cost(F.col("cost_usd"), F.col("input_tokens"), F.col("output_tokens"), prices))


def cost(explicit: Column, input_tokens: Column, output_tokens: Column, prices: tuple[float, float] | None = None) -> Column:
    """The given cost, else tokens at prices per 1000 (in, out), else null; to 6 places."""
    made = F.lit(None).cast("double") if prices is None else input_tokens / 1000 * prices[0] + output_tokens / 1000 * prices[1]
    return F.round(F.coalesce(explicit, made), 6)


def run_report(results: DataFrame) -> DataFrame:
    """One row of score_answers()'s results (with latency_seconds): counts, error_rate, latency, means, rates and costs."""
    rate = lambda c: F.avg(c.cast("double"))
    parts = [
        F.count("*").alias("num_cases"),
        F.count("error").alias("num_errors"),
        F.round(rate(F.col("error").isNotNull()), 4).alias("error_rate"),
        F.round(F.avg("latency_seconds"), 4).alias("mean_seconds"),
        F.round(rounded_rank(results, "latency_seconds"), 4).alias("p95_seconds"),
        F.round(F.max("latency_seconds"), 4).alias("max_seconds"),
        F.round(F.avg("token_f1"), 4).alias("avg_token_f1"),
        F.round(F.avg("sequence_similarity"), 4).alias("avg_sequence_similarity"),
        F.round(rate(F.coalesce("answered", F.lit(False))), 4).alias("answered_rate"),
        F.round(rate(F.col("refused")), 4).alias("refusal_rate"),
        F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"),
        F.round(F.avg("cost_usd"), 4).alias("avg_cost_usd"),
        F.count("cost_usd").alias("num_cases_with_cost"),
        F.count("retrieval").alias("num_cases_with_citations"),
        F.round(rate(F.col("retrieval.hit")), 4).alias("hit_rate"),
        F.round(F.avg("retrieval.reciprocal_rank"), 4).alias("mrr"),
        F.round(F.avg("retrieval.precision"), 4).alias("avg_precision"),
        F.round(F.avg("retrieval.recall"), 4).alias("avg_recall"),
    ]
    return results.agg(*parts)


def by_category(results: DataFrame, category: str = "product_category") -> DataFrame:
    return results.groupBy(category).agg(F.count("*").alias("num_cases"), F.round(F.avg("token_f1"), 4).alias("avg_token_f1"))


def judged(scores: DataFrame, keys: tuple[str, ...] = ("faithfulness", "answer_relevance", "correctness", "context_relevance")) -> DataFrame:
    """Scores of a judge, given as text or numbers, within 0 and 1 to 4 places; what is no number is null."""
    clamp = lambda x: F.when(x.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4))
    return scores.withColumns({k: clamp(F.col(k).try_cast("double")) for k in keys if k in scores.columns})


def flattened(report: DataFrame, skip: tuple[str, ...] = ("by_category",)) -> DataFrame:
    """(metric, value) of a report of one row: the numbers in it, those in structs by dotted names; without the fields of skip."""

    def leaves(fields, path=()):
        for f in fields:
            if f.name in skip:
                continue
            at = (*path, f.name)
            if f.dataType.typeName() == "struct":
                yield from leaves(f.dataType.fields, at)
            elif f.dataType.typeName() in ("integer", "long", "short", "byte", "float", "double", "decimal", "boolean"):
                yield at

    cells = [F.struct(F.lit(".".join(p)).alias("metric"), F.col(".".join(f"`{x}`" for x in p)).cast("double").alias("value")) for p in leaves(report.schema.fields)]
    return report.select(F.explode(F.array(*cells)).alias("c")).select("c.metric", "c.value").filter("value IS NOT NULL")


def against_baseline(baseline: DataFrame, current: DataFrame, band: float = 0.03, lower_is_better: tuple[str, ...] = LOWER_IS_BETTER) -> DataFrame:
    """metric, baseline, current, delta and verdict (improved, degraded or unchanged) of two tables (metric, value), for the metrics of
    both. delta is the signed share of the baseline; from a baseline of 0 it is 0 to 0, and infinite to anything else. A metric whose
    name ends in one of lower_is_better is better when lower. Changes within the band are none."""
    b, c = baseline.select("metric", F.col("value").alias("baseline")), current.select("metric", F.col("value").alias("current"))
    change = (F.col("current") - F.col("baseline")) / F.abs(F.when(F.col("baseline") != 0, F.col("baseline")))
    delta = F.when(F.col("baseline") != 0, change).when(F.col("current") == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    lower = F.lit(False)
    for suffix in lower_is_better:
        lower = lower | F.col("metric").endswith(suffix)
    gain = F.when(lower, -F.col("delta")).otherwise(F.col("delta"))
    verdict = F.when(gain > band, "improved").when(gain < -band, "degraded").otherwise("unchanged")
    both = b.join(c, "metric").filter("baseline IS NOT NULL AND current IS NOT NULL")
    return both.withColumn("delta", delta).withColumn("verdict", verdict).withColumn("delta", F.round("delta", 4))


def similarity_report(rows: DataFrame, threshold: float) -> DataFrame:
    """category, n, least, mean, greatest and hits of (category, similarity: null if nothing was found)."""
    s = F.col("similarity")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.min(s).alias("least"), F.avg(s).alias("mean"), F.max(s).alias("greatest"), F.count_if(s >= threshold).alias("hits")).filter("least IS NOT NULL")


def separability(rows: DataFrame, threshold: float) -> DataFrame:
    """One row: the lowest similarity of wanted matches (paraphrase, exact), the highest of unwanted ones (near-miss, unrelated), whether
    they are separable, the gap, and whether the threshold sits inside it."""
    wanted, other = F.col("category").isin("paraphrase", "exact"), F.col("category").isin("near-miss", "unrelated")
    out = rows.agg(F.min(F.when(wanted, F.col("similarity"))).alias("low"), F.max(F.when(other, F.col("similarity"))).alias("high"))
    low, high = F.col("low"), F.col("high")
    return out.select("low", "high", (low > high).alias("separable"), (low - high).alias("gap"), ((high < threshold) & (F.lit(threshold) <= low)).alias("inside"))


def match_problems(cases: DataFrame, threshold: float) -> DataFrame:
    """cases (category, query, expected_question, best_id, best_question, similarity) with hit and wrong: a false hit, a miss, no result
    or the wrong question; null if right."""
    s, positive = F.col("similarity"), F.col("category").isin("exact", "paraphrase")
    hit = F.coalesce(s >= threshold, F.lit(False))
    want = F.when(T.strip(F.coalesce("expected_question", F.lit(""))) != "", T.question_id(F.col("expected_question")))
    wrong = F.when(F.col("category").isin("near-miss", "unrelated") & hit, "false hit").when(positive & ~hit & s.isNull(), "no result")
    wrong = wrong.when(positive & ~hit, "missed").when(positive & want.isNotNull() & (F.col("best_id") != want), "wrong question")
    return cases.withColumn("hit", hit).withColumn("wrong", wrong)
