from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillstone.operators import questions as Q


def test_priority_dedup(spark):
    rows = [
        ("c1", "https://x/news/", 0, "What is a pension?\nOnly here?", ""),
        ("c2", "https://x/pensions/a", 3, "what is a pension", "Kept one?"),
        ("c3", "https://x/pensions/b", 0, "", "WHAT IS A PENSION?!"),
        ("c4", "https://x/general/", 0, "What is a pension", "Twice?\nTwice?"),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_url string, chunk_index int, title_questions string, augmented_questions string")
    got = {r.chunk_id: (r.title_questions, r.augmented_questions) for r in Q.dedup_questions(chunks, generic=("/general/",)).collect()}
    assert got == {"c1": ("Only here?", ""), "c2": ("", "Kept one?"), "c3": ("", "WHAT IS A PENSION?!"), "c4": ("", "Twice?\nTwice?")}
    three = Q.dedup_questions(chunks.filter("chunk_id <> 'c4'"))
    assert sorted(map(tuple, three.collect())) == sorted(rows[:3])


def test_collisions(spark):
    rows = [("c1", "p1", "A?"), ("c1", "p1", "a"), ("c2", "p1", "a!"), ("c3", "p2", "b"), ("c4", "p1", "B"), *[(f"d{i}", f"p{i}", "hot") for i in range(22)]]
    df = spark.createDataFrame(rows, "chunk string, url string, question string")
    got = {r.question: (r.n, r.n_urls, r.severity, r.slots) for r in Q.collisions(df, "chunk", "url").collect()}
    assert got == {"a": (2, 1, "low", 0), "b": (2, 2, "low", 0), "hot": (22, 22, "critical", 5)}
    found = Q.collisions(df, "chunk", "url")
    assert tuple(Q.collision_impact(found).first()) == (2, 1, 5) and [r.question for r in Q.dangerous(found).collect()] == ["hot"]
    s = Q.collision_summary(df, found, "chunk").first()
    assert (s.n_questions, s.n_unique, s.n_colliding, s.rate_pct) == (27, 3, 3, 100.0)


def test_quality(spark):
    content = "Our workplace pension has employer contributions and tax relief."
    cases = [("How do employer contributions work for my pension?", 2, True), ("What is a pension?", 0, True), ("Which employer pays the most now", 1, True), ("How can I find guides on saving and budgeting?", 0, False), ("Completely unrelated words in this sentence", 0, False)]
    df = spark.createDataFrame([(q, content) for q, _, _ in cases], "q string, c string")
    got = df.select(Q.question_score(F.col("q"), F.col("c")), Q.is_title_question(F.col("q"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(s, t) for _, s, t in cases]
    e = df.limit(1).select(Q.is_evidence(F.lit("WORKPLACE pension, has employer"), F.col("c")), Q.is_evidence(F.lit("pension"), F.col("c")), Q.is_valid_generated(F.lit("short")), Q.is_valid_generated(F.lit("long enough"), "enough")).first()
    assert tuple(e) == (True, False, False, False)


def test_seeds(spark):
    kind = "pos_in_index int, product_category string, source_url string, parent_url string, chunk_id string, chunk_index int, title_questions string, augmented_questions string"
    rows = [(1, "x", "https://a#state=1", "https://a", "c1", 0, "- First one?", "Second one?\nfirst ONE"), (2, "x", "https://a", "", "c2", 1, "", "Third one?\nFourth one?"), (3, "x", "", "", "c3", 0, "Lost one?", ""), (4, "y", "https://b", None, "c4", 0, "Second one!", "Fifth one?")]
    got = [(r.source_url, r.question) for r in Q.seed_rows(spark.createDataFrame(rows, kind), 3).orderBy("chunk_id", "question").collect()]
    assert sorted(got) == [("https://a", "First one?"), ("https://a", "Second one?"), ("https://a", "Third one?"), ("https://b", "Fifth one?")]


def test_fuzzy_dedup_equals_a_plain_loop(spark):
    rows = [(i, c, q) for i, (c, q) in enumerate([("a", "What is a pension?"), ("a", "what is a pension"), ("b", "What is a pension?"), ("a", "How do I claim"), ("a", "What is a pensions?"), (None, "x"), (None, "x"), ("a", "How do I claim it")])]
    got = {r.i for r in Q.fuzzy_dedup(spark.createDataFrame(rows, "i int, c string, q string"), "c", "q", "i").collect()}
    kept = {}
    for i, c, q in rows:
        norm = "".join(x for x in q.lower() if x.isalnum() or x == " ").strip()
        if all(SequenceMatcher(None, norm, o).ratio() < 0.85 for o, _ in kept.get(c, [])):
            kept.setdefault(c, []).append((norm, i))
    assert got == {i for v in kept.values() for _, i in v}


def test_samples(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i < 6 else "a") for i in range(12)], "i int, c string")
    assert [r.i for r in Q.round_robin(rows, "c", "i", 7, 3).collect()] == [0, 1, 2, 3, 4, 5, 6]
    one, two = ([r.i for r in Q.stratified(rows, "c", "i", 6, 3, rows.filter("i < 2")).collect()] for _ in range(2))
    assert one == two and len(one) == 6 and not {0, 1} & set(one)
    assert Q.with_signal(spark.createDataFrame([("one two three four five",), ("one, two",)], "q string"), "q").count() == 1
    assert [r.c for r in Q.by_category(rows, "c", exclude=("a", "b")).select("c").distinct().collect()] == ["c"]
    chunks = spark.createDataFrame([(i, ["x", "y", "z"][i % 3], ["short", "medium", "long"][i % 4 % 3], ["first", "middle", "last"][i % 5 % 3]) for i in range(60)], "chunk_id int, content_type string, size_category string, position string")
    got = Q.representative(chunks, 12, {"x": 0.5, "y": 0.5}).collect()
    assert len(got) == 12 and {"long", "medium"} <= {r.size_category for r in got} and {"first", "last"} <= {r.position for r in got} and "z" not in {r.content_type for r in got}


def test_pairs_are_the_greedy_choice(spark):
    pages = [(0, "a", "abcdef"), (1, "a", "abcdex"), (2, "a", "abcyzx"), (3, "b", "abcdef"), (4, "a", "zzyyww"), (5, "b", "abcxyz"), (6, "b", "qrstuv")]
    rows = spark.createDataFrame([(i, c, sorted(set(t))) for i, c, t in pages], "id int, c string, t array<string>")
    got = [(r.a, r.b) for r in Q.topic_pairs(rows, "id", "c", "t", 5).collect()]
    cands = sorted((-len(set(x) & set(y)) / len(set(x) | set(y)), i, j) for i, c, x in pages for j, d, y in pages if i < j and c == d)
    used, want = set(), []
    for s, i, j in cands:
        if -s > 0.08 and not {i, j} & used:
            want.append((i, j))
            used |= {i, j}
    assert got == want
    terms = Q.top_terms(spark.createDataFrame([(1, "alpha beta alpha gamma with the beta alpha zeta")], "id int, t string"), "id", "t", 2).first().terms
    assert terms == ["alpha", "beta"]


def test_models(spark):
    a = spark.createDataFrame([("q1", True, 4), ("q2", False, 2), ("q3", None, None), ("q4", True, 1)], "question string, keep boolean, score int")
    b = spark.createDataFrame([("q1", True, 5), ("q2", True, 2), ("q3", True, 3)], "question string, keep boolean, score int")
    assert tuple(Q.agreement(a, b).first()) == (3, 66.7, 0.33, 1)
    models = spark.createDataFrame([("GPT-5-mini-eu", 1_000_000, 2_000_000), ("unknown", 500_000, 0)], "model string, input_tokens bigint, output_tokens bigint")
    usage = Q.token_usage(models)
    assert {r.model: r.cost for r in usage.collect()} == {"GPT-5-mini-eu": 11.25, "unknown": 1.0} and Q.token_totals(usage).first().cost == 12.25
    p = models.select(Q.resolved_price(F.lit("gpt-4o"), (("gpt-4o-mini", 1.0, 2.0), ("gpt-4o", 3.0, 4.0)), (9.0, 9.0)), Q.resolved_price(F.lit("my-gpt-4o-mini"), (("gpt-4o-mini", 1.0, 2.0),), (9.0, 9.0)), Q.resolved_price(F.lit("z"), (("gpt", 1.0, 2.0),), (9.0, 9.0))).first()
    assert [tuple(x) for x in p] == [(3.0, 4.0), (1.0, 2.0), (9.0, 9.0)]
    text = models.limit(1).select(Q.embedding_text(F.lit("body"), F.lit("A?\n"), F.lit(" "))).first()[0]
    assert text == "body\n\nEntry-point questions this page answers:\nA?"


def test_hooks(spark):
    from quillstone.operators import serving

    def ask(chunk):
        if chunk["t"] == "bad":
            raise ValueError
        return {"questions": chunk["t"].upper()}

    df = spark.createDataFrame([("a",), ("bad",)], "t string")
    assert [r.questions for r in Q.generated(df, ask, ["t"], "questions string").collect()] == ["A", None]
    out = serving.answered(df, lambda q: {"answer": q} if q == "a" else 1 / 0, "t").collect()
    assert out[0].answer == "a" and out[1].error.startswith("ZeroDivisionError") and out[1].latency_seconds >= 0
    got = serving.embedded(df, "t", lambda texts: [[float(len(t)), 0.0] for t in texts], 2).collect()
    assert [r.embedding for r in got] == [[1.0, 0.0], [3.0, 0.0]]
