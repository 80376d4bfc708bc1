"""The golden values of retrieval metrics, and reports on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import metrics as M
from quillstone.operators import evaluation as E

CASE = "query_id string, query string, answer_type string, relevant map<string,int>, answerable boolean, error string, category string, variant string, provenance string"
FOUND = "query_id string, pos int, url string, score double, rerank double"


def _scores(spark, relevant, ranked, kind):
    df = spark.createDataFrame([(relevant, ranked, kind)], "rel map<string,int>, ranked array<string>, kind string")
    return df.select(*M.score_row(F.col("rel"), F.col("ranked"), F.col("kind"))).first()


def test_metrics(spark):
    m = _scores(spark, {"A": 2}, ["B", "A", "C"], "single")
    assert (m.first_rel_rank, m.mrr, m.hit_1, m.hit_3, m.success_3) == (2, 0.5, 0.0, 1.0, 1.0)
    m = _scores(spark, {"A": 2, "B": 2}, ["A", "C", "D"], "multi_required")
    assert (m.recall_3, m.all_3, m.success_3, m.hit_3) == (0.5, 0.0, 0.0, 1.0)
    m = _scores(spark, {"A": 2, "B": 2}, ["C", "B", "A"], "multi_required")
    assert (m.success_3, m.success_1) == (1.0, 0.0)
    assert _scores(spark, {"A": 2, "B": 1}, ["A", "B"], "multi_any").ndcg_10 == pytest.approx(1.0)
    m = _scores(spark, {"A": 2, "B": 1}, ["B", "A"], "multi_any")
    assert m.ndcg_10 < 1.0 and m.success_1 == 1.0
    assert _scores(spark, {"A": 2}, ["B", "C"], "single").mrr == 0.0


def test_bundle(spark):
    df = spark.createDataFrame([([" A", "b", "b"], ["a"]), (["b"], ["a", "B "]), ([], ["a"]), (["a"], [])], "ranked array<string>, rel array<string>")
    got = [r[0] and tuple(r[0]) for r in df.select(M.score_retrieval(F.col("ranked"), F.col("rel"), 2)).collect()]
    assert got == [(True, 0.5, 1.0, 1.0, 3), (True, 1.0, 0.5, 1.0, 1), None, None]
    assert [r[0] for r in df.select(M.precision_at(F.col("ranked"), F.col("rel"), 3)).collect()] == [pytest.approx(1 / 3), 1.0, 0.0, 0.0]
    assert [r[0] for r in df.select(M.recall_at(F.col("ranked"), F.col("rel"), 3)).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_grouping(spark):
    found = spark.createDataFrame([("q", 0, "A", 1.0, 1.0), ("q", 1, "A", 1.0, 3.0), ("q", 2, "B", 1.0, 2.0), ("q", 3, "C", 1.0, None), ("r", 0, "B", 1.0, None), ("r", 1, "A", 1.0, None)], FOUND)
    got = [(r.query_id, r.url, r.rerank) for r in E.group_by_url(found).orderBy("query_id", "rank").collect()]
    assert got == [("q", "A", 3.0), ("q", "B", 2.0), ("q", "C", None), ("r", "B", None), ("r", "A", None)]


def _row(qid, q, kind, rel, variant="plain", ok=True, error=None):
    return (qid, q, kind, rel, ok, error, "c", variant, "synthetic")


def _found(canned, rows):
    return [(r[0], i, u, 1.0, s) for r in rows for i, (u, s) in enumerate(canned.get(r[1], []))]


def test_pipeline(spark):
    rows = [_row("S1", "q1", "single", {"A": 2}), _row("S2", "q2", "single", {"B": 2}), _row("M1", "q3", "multi_required", {"A": 2, "C": 2})]
    rows += [_row("STALE", "q4", "single", {"gone": 2}), _row("U1", "q5", "unanswerable", {}, "out_of_scope", False), _row("BOOM", "boom", "single", {"A": 2}, error="outage")]
    canned = {"q1": [("A", 3.5), ("B", 1.0)], "q2": [("C", 3.5), ("D", 1.0)], "q3": [("A", 3.5), ("D", 3.0), ("C", 2.5)], "q5": [("D", 0.5)]}
    urls = spark.createDataFrame([(x,) for x in "ABCD"], "url string")
    res = E.evaluate(spark.createDataFrame(rows, CASE), spark.createDataFrame(_found(canned, rows), FOUND), urls).cache()
    assert {r.query_id: r.status for r in res.collect()} == {"S1": "ok", "S2": "ok", "M1": "ok", "STALE": "stale_ground_truth", "U1": "ok", "BOOM": "error"}
    assert tuple(E.counts(res).first()) == (6, 3, 1, 1, 1)
    overall = E.means(res.filter("status = 'ok' AND answerable")).first()
    assert overall.success_1 == pytest.approx(1 / 3) and overall.success_3 == pytest.approx(2 / 3) and overall.n == 3
    by = {(r.key, r.value): r.n for r in E.breakdowns(res.filter("status = 'ok' AND answerable"), ["answer_type", "variant"]).collect()}
    assert by == {("answer_type", "single"): 2, ("answer_type", "multi_required"): 1, ("variant", "plain"): 3}


def test_threshold(spark):
    rows = [_row("S1", "q1", "single", {"B": 2}), _row("S2", "q2", "single", {"A": 2}), _row("S3", "q5", "single", {"D": 2})]
    rows += [_row("U1", "q3", "unanswerable", {}, "out_of_scope", False), _row("U2", "q4", "unanswerable", {}, "in_domain_gap", False)]
    canned = {"q1": [("A", 3.5), ("B", 1.0)], "q2": [("A", 3.5)], "q3": [("D", 0.5)], "q4": [("C", 3.0)], "q5": [("D", 0.5)]}
    urls = spark.createDataFrame([(x,) for x in "ABCD"], "url string")
    res = E.evaluate(spark.createDataFrame(rows, CASE), spark.createDataFrame(_found(canned, rows), FOUND), urls, 2.0).cache()
    by = {r.query_id: r for r in res.collect()}
    assert by["S3"].ranked_urls == ["D"] and by["S3"].is_confident is False and by["S1"].ranked_urls == ["A"] and by["S1"].raw_success_5 == 1.0
    answered = res.filter("answerable")
    m = E.means(answered).first()
    assert m.success_5 == pytest.approx(2 / 3) and m.raw_success_5 == 1.0
    assert {r.variant: r.fp_rate for r in E.false_positives(res).collect()} == {"out_of_scope": 0.0, "in_domain_gap": 1.0}
    assert answered.agg(F.avg(F.col("is_confident").cast("int"))).first()[0] == pytest.approx(2 / 3)


def test_percentiles(spark):
    xs = spark.createDataFrame([(float(x),) for x in range(1, 11)], "x double")
    assert tuple(xs.agg(E.nearest_rank("x", 50), E.nearest_rank("x", 95), E.rounded_rank(xs, "x")).first()) == (5.0, 10.0, 10.0)
    for n in (1, 2, 7, 31, 40):
        df = spark.createDataFrame([(float(x),) for x in range(n)], "x double")
        assert df.agg(E.rounded_rank(df, "x")).first()[0] == sorted(range(n))[min(n - 1, round(0.95 * (n - 1)))]


def test_bootstrap(spark):
    xs = spark.createDataFrame([(i, float(i % 2)) for i in range(400)], "i int, x double")
    low, high = E.bootstrap(xs, "x", 300).first()
    assert 0.40 < low < 0.5 < high < 0.60 and tuple(E.bootstrap(xs, "x", 300).first()) == (low, high)
    for few in (xs.limit(1), xs.limit(0), xs.withColumn("x", F.lit(None).cast("double"))):
        assert tuple(E.bootstrap(few, "x", 300).first()) == (None, None)
    assert tuple(E.bootstrap(xs, "x", 99).first()) == (None, None)


def test_bootstrap_of_equal_rows(spark):
    """Equal rows are drawn apart: the interval is that of a plain bootstrap, within its own spread, whatever else stands in a row."""
    rng = random.Random(3)
    sets = {"halves": [0.0, 1.0] * 500, "rare": [1.0] * 30 + [0.0] * 1970, "mixed": [rng.gauss(3, 1) for _ in range(300)] + [2.0] * 700, "few": [0.0, 0.0, 1.0], "alike": [0.7] * 50}
    for name, xs in sets.items():
        means = sorted(sum(rng.choices(xs, k=len(xs))) / len(xs) for _ in range(600))
        want = means[15], means[584]
        got = tuple(E.bootstrap(spark.createDataFrame([(x,) for x in xs], "x double"), "x", 600).first())
        slack = 0.2 * (want[1] - want[0]) + 1e-9
        assert all(abs(g - w) <= slack for g, w in zip(got, want, strict=True)), (name, got, want)


def test_bootstrap_draws_any_count(spark):
    """A value that occurs very often: as many draws for it as for its count in base 32; the spread is that of the mean."""
    n = 200_000
    low, high = E.bootstrap(spark.range(n).selectExpr("double(id % 2) AS x"), "x", 400).first()
    spread = 2 * 1.96 * 0.5 / n**0.5
    assert low < 0.5 < high and 0.75 * spread < high - low < 1.25 * spread


def test_baseline_verdicts(spark):
    rows = [("recall", 0.5, 0.6), ("latency.mean_seconds", 2.0, 3.0), ("zero", 0.0, 1.0), ("still", 0.0, 0.0), ("edge", 1.0, 1.02), ("error_rate_x", 1.0, 2.0), ("error_rate", 0.0, 1.0)]
    base, now = (spark.createDataFrame([(r[0], r[i]) for r in rows] + more, "metric string, value double") for i, more in ((1, []), (2, [("new", 1.0)])))
    got = {r.metric: (r.delta, r.verdict) for r in E.against_baseline(base, now).collect()}
    inf = float("inf")
    assert got == {"recall": (0.2, "improved"), "latency.mean_seconds": (0.5, "degraded"), "zero": (inf, "improved"), "still": (0.0, "unchanged"), "edge": (0.02, "unchanged"), "error_rate_x": (1.0, "improved"), "error_rate": (inf, "degraded")}


def test_answer_report(spark):
    kind = "expected string, answer string, citations array<string>, relevant array<string>, refused boolean, cost_usd double, input_tokens int, output_tokens int, error string, latency_seconds double, product_category string"
    rows = [("A b", "a [1] c", ["u"], ["U "], None, None, 1000, 1000, None, 1.0, "x"), ("a", "I cannot provide that", [], ["u"], None, 0.5, None, None, None, 2.0, "x"), ("a", None, None, None, None, None, None, None, "boom", 3.0, "y")]
    got = E.score_answers(spark.createDataFrame(rows, kind), 5, (0.002, 0.008)).cache()
    one, two, three = got.orderBy("latency_seconds").collect()
    assert (one.token_f1, one.answered, one.refused, one.cost_usd, one.retrieval.hit) == (0.5, True, False, 0.01, True)
    assert (two.refused, two.cost_usd, two.retrieval) == (True, 0.5, None) and three.token_f1 is None
    r = E.run_report(got).first()
    assert (r.num_cases, r.num_errors, r.p95_seconds, r.total_cost_usd, r.hit_rate, r.num_cases_with_citations) == (3, 1, 3.0, 0.51, 1.0, 1)
    flat = {x.metric: x.value for x in E.flattened(E.run_report(got)).collect()}
    assert flat["num_cases"] == 3.0 and "avg_token_f1" in flat
    assert {x.product_category: x.num_cases for x in E.by_category(got).collect()} == {"x": 2, "y": 1}


def test_judge_and_matches(spark):
    df = spark.createDataFrame([("1.7", "x"), ("0.33333", None)], "faithfulness string, correctness string")
    assert [tuple(r) for r in E.judged(df).collect()] == [(1.0, None), (0.3333, None)]
    kind = "category string, query string, expected_question string, best_id string, best_question string, similarity double"
    rows = [("exact", "q", "What is a pension?", "q-90b03001c3", "b", 0.95), ("exact", "q", "Other", "q-90b03001c3", "b", 0.95), ("paraphrase", "q", None, "i", "b", 0.5), ("exact", "q", "x", None, None, None), ("near-miss", "q", None, "i", "b", 0.92), ("unrelated", "q", None, "i", "b", 0.1)]
    out = E.match_problems(spark.createDataFrame(rows, kind), 0.9)
    assert [r.wrong for r in out.collect()] == [None, "wrong question", "missed", "no result", "false hit", None]
    sep = E.separability(out, 0.9).first()
    assert (sep.low, sep.high, sep.separable, sep.inside) == (0.5, 0.92, False, False)
    rep = {r.category: (r.n, r.hits) for r in E.similarity_report(out, 0.9).collect()}
    assert rep == {"exact": (3, 2), "paraphrase": (1, 0), "near-miss": (1, 1), "unrelated": (1, 0)}
