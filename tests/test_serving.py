import datetime as dt

from pyspark.sql import functions as F

from quillstone.operators import serving as S

FOUND = "query_id int, pos int, chunk_id string, url string, parent_url string, title string, score double, rerank double, answer_score double"


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "query_id int, rank int, doc_id int")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "query_id int, rank int, doc_id int")
    got = S.fused([a, b], 2).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(11, round(1 / 62 + 1 / 61, 6)), (10, round(1 / 61, 6))]
    fields = spark.createDataFrame([(1, 5, "title", 2.0), (1, 5, "other", 1.0)], "query_id int, doc_id int, field string, score double")
    assert S.weighted(fields, {"title": 4.0}).first().score == 9.0


def test_retrieve(spark):
    rows = [(1, 1, "a", "u1", None, "T", 0.1, 0.6, None), (1, 2, "b", "u1", "", "T", 0.9, 0.4, 0.9), (1, 3, "c", "u2", "up", "T", 0.2, None, 0.8), (1, 4, "d", "u3", "", "T", 0.2, 0.7, 0.75)]
    rows += [(1, 10 + i, f"e{i}", f"v{i}", "", "T", 0.2, 0.55, None) for i in range(8)]
    rows += [(2, 1, "a", "u1", "", "T", 0.005, None, 0.9), (3, 1, "a", "u1", "", "What is a pension", 0.5, None, None), (3, 2, "b", "u2", "", "Other", 0.6, None, None)]
    queries = spark.createDataFrame([(1, True, "SPECIFIC", "q"), (2, False, "SPECIFIC", "q"), (3, False, "BROAD", "what is a pension")], "query_id int, semantic boolean, kind string, query string")
    got = [(r.query_id, r.chunk_id, r.is_answer) for r in S.retrieve(spark.createDataFrame(rows, FOUND), queries).orderBy("query_id", "place").collect()]
    assert got == [(1, "b", True), (1, "c", True), (1, "e0", False), (1, "e1", False), (1, "e2", False), (3, "a", False), (3, "b", False)]


def test_semantic_gate(spark):
    kind = "query string, disclaimer boolean, bereavement boolean, confidence double, n_history int, kind string"
    rows = [("what is x", False, False, 1.0, 0, "SPECIFIC"), ("what is x", True, False, 1.0, 0, None), ("what is x", False, False, 0.0, 0, None), ("what is x", False, False, None, 2, None), ("compare x", False, False, 1.0, 0, None), ("what is x", False, False, 0.8, 0, None), ("what is x", False, False, 1.0, 0, "BROAD"), ("one two three four five six seven eight nine", False, False, 1.0, 0, None)]
    df = spark.createDataFrame(rows, kind)
    assert [r[0] for r in df.select(S.uses_semantic({c: F.col(c) for c in df.columns})).collect()] == [False, True, True, True, True, True, True, True]


def test_cache(spark):
    at = dt.datetime(2024, 1, 1)
    cache = spark.createDataFrame([("k1", [1.0, 0.0], at), ("k2", [1.0, 0.0], at), ("k3", [0.0, 1.0], at - dt.timedelta(hours=2))], "key string, embedding array<float>, at timestamp")
    queries = spark.createDataFrame([(1, [2.0, 0.1]), (2, [0.0, 3.0]), (3, [0.0, 0.0])], "query_id int, embedding array<float>")
    assert sorted((r.query_id, r.key) for r in S.nearest_cached(queries, cache).collect()) == [(1, "k1"), (2, "k3")]
    assert [(r.query_id, r.key) for r in S.nearest_cached(queries, cache, now=F.lit(at), ttl=3600).collect()] == [(1, "k1")]
    assert S.nearest_cached(queries, cache.limit(0)).count() == 0
    writes = spark.createDataFrame([("k1", [0.5, 0.5], at + dt.timedelta(hours=1))], cache.schema)
    assert sorted((r.key, r.at) for r in S.cached_writes(cache, writes, 2).collect()) == [("k1", at + dt.timedelta(hours=1)), ("k2", at)]
    rows = spark.createDataFrame([("a", False, False, False, None), ("a", True, False, False, None), ("", False, False, False, False), ("a", False, False, True, False)], "answer string, refused boolean, cache_hit boolean, needs_empathy boolean, follows_up boolean")
    assert [r[0] for r in rows.select(S.may_cache()).collect()] == [True, False, False, False]


def test_batch(spark):
    kind = "query_id int, query string, last_user string, n_history int, intent string, confidence double, embedding array<float>, canonical_embedding array<float>"
    far, near = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (1, "<b>Hello!</b>", None, 0, "GREETING", 1.0, far, None),
        (2, "look up my pension please", None, 0, "INSURANCE", 1.0, far, None),
        (3, "tell me the football scores", None, 0, "IRRELEVANT", 1.0, far, None),
        (4, "how are pensions going today my friend", None, 0, "CHITCHAT", 0.95, far, None),
        (5, "are you sure about pensions", "what is a pension", 2, "CHITCHAT", 0.95, near, near),
        (6, "what is a pension", None, 0, "INSURANCE", 1.0, near, None),
        (7, "what is an annuity", None, 0, "INSURANCE", 1.0, far, near),
        (8, "my father died, what about his pension", None, 0, "INSURANCE", 1.0, near, None),
        (9, "which pension do you recommend", None, 0, None, None, near, None),
        (10, "  ", None, 0, "INSURANCE", 1.0, far, None),
    ]
    cache = spark.createDataFrame([("k", near, dt.datetime(2024, 1, 1))], "key string, embedding array<float>, at timestamp")
    got = {r.query_id: r for r in S.run_batch(spark.createDataFrame(rows, kind), cache, {"general": "g", "irrelevant": "no"}).collect()}
    outcome = {i: r.outcome for i, r in got.items()}
    assert outcome == {1: "GREETING", 2: "ACCOUNT_LOOKUP", 3: "irrelevant", 4: "CHITCHAT", 5: "CACHE", 6: "CACHE", 7: "CACHE", 8: None, 9: None, 10: "empty"}
    assert got[3].answer == "no" and got[5].follows_up == "disagreement" and got[8].needs_empathy and got[8].bereavement and got[9].recommendation and got[9].confidence == 0.0
    assert got[9].kind == "SPECIFIC" and got[9].semantic


def test_prompts(spark):
    kind = "q string, turns array<struct<role:string,content:string>>, chunks array<struct<title:string,section:string,url:string,content:string>>, sad boolean"
    df = spark.createDataFrame([("Why?", [("user", f"m{i}") for i in range(8)], [("T", "S", "u", "c1"), ("", "S", "v", "c2")], True), ("Why?", [], [], False)], kind)
    p = [r[0] for r in df.select(S.prompt(F.col("q"), F.col("turns"), F.col("chunks"), [(F.col("sad"), "NOTE: kind.")], "Answer.", F.lit(True), "From history.")).collect()]
    assert p[0].startswith("Previous conversation:\nUser: m2\n") and "NOTE: kind.\n\nContext:\n\n[1] Source: T (u)\nc1\n\n---\n\n[2] Source: S (v)\nc2\n\nCustomer question: Why?\n\nAnswer." in p[0]
    assert p[1] == "Customer question: Why?\n\nFrom history."


def test_final_answers(spark):
    df = spark.createDataFrame([("See [2] and [1].\n---", False), ("x I DON'T KNOW y [1]", False), ("Plain [1]", True)], "a string, sad boolean")
    out = [r[0] for r in df.select(S.finalised(F.col("a"), F.array(F.lit("u"), F.lit("v")), [("I DON'T KNOW", "unknown", ["contact"])], [(F.col("sad"), ["help", "u"])])).collect()]
    assert [tuple(r) for r in out] == [("See [1] and [2].", None, ["v", "u"]), ("I DON'T KNOW", "unknown", ["contact"]), ("Plain [1]", None, ["u", "help"])]
    long = spark.createDataFrame([("w " * 500,), ("short",)], "t string").select(S.shortened(F.col("t"))).collect()
    assert long[0][0].endswith("w...") and len(long[0][0].split()) == 400 and long[1][0] == "short"
    assert df.limit(1).select(S.output_reason([F.lit(3)]), S.output_reason([F.lit(1)])).first() == ("unsafe_output", None)


def test_history(spark):
    rows = [("c", 0, "system", "s"), ("c", 1, "user", "u1"), ("c", 2, "assistant", "a"), ("c", 3, "user", "u2")]
    got = S.last_user(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).orderBy("turn").collect()
    assert [(r.last_user, r.n_history) for r in got] == [(None, 0), (None, 1), ("u1", 2), ("u1", 3)]


def test_reranking_and_ids(spark):
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12)], "query_id int, rank int, doc_id int")
    scores = spark.createDataFrame([(1, 12, 2.0), (1, 11, 3.0)], "query_id int, doc_id int, rerank double")
    assert [r.doc_id for r in S.reranked(found, scores).orderBy("rank").collect()] == [11, 12, 10]
    ids = [r.request_id for r in S.with_request_ids(spark.createDataFrame([("a",), ("",), (None,)], "request_id string")).collect()]
    assert ids[0] == "a" and len(set(ids)) == 3 and all(ids)


def test_retries():
    tried = []

    def call(kind):
        tried.append(1)
        if len(tried) < 3:
            raise kind
        return "ok"

    assert S.retrying(call, base=0.001)(TimeoutError()) == "ok" and len(tried) == 3
    tried.clear()
    try:
        S.retrying(call, base=0.001)(ValueError())
    except ValueError:
        assert len(tried) == 1
    throttled = RuntimeError()
    throttled.status_code = 429
    assert S.is_transient(throttled) and not S.is_transient(RuntimeError())


def test_checks(spark):
    found = spark.createDataFrame([(1, 1, "https://p/a"), (2, 11, "https://p/b")], "query_id int, rank int, url string")
    expected = spark.createDataFrame([(1, "/a"), (2, "/b")], "query_id int, fragment string")
    assert tuple(S.retrieval_check(found, expected).first()) == (2, 1, "failed")
    assert S.url_hits(found.withColumnRenamed("url", "source_url"), "/b").count() == 1
