import pytest
from pyspark.sql import functions as F

from quillstone.operators import sync as S

CHUNK = "chunk_id string, source_url string, dropdown_url string, content_hash string, video_url string, refresh_count int"


def _chunks(spark, rows):
    return spark.createDataFrame([(i, u, d, h, v, n) for i, u, d, h, v, n in rows], CHUNK)


def test_stale_plan_and_gate(spark):
    stored = _chunks(spark, [("a", "https://p/1/", "", "", "", 0), ("b", "https://p/1", "https://p/1#state=x", "", "", 0), ("c", "https://p/2", "", "", "", 0), ("d", "https://p/3", "", "", "", 0), ("e", "https://p/4", None, "", "", 0)])
    fresh = _chunks(spark, [("a", "https://p/1", "", "", "", 0), ("z", "https://p/2", "", "", "", 0)])
    failed = spark.createDataFrame([("https://p/3/",)], "url string")
    plan = S.stale_plan(stored, fresh, failed).cache()
    assert {r.chunk_id: (r.action, r.gone) for r in plan.collect()} == {"a": ("keep", False), "b": ("stale", True), "c": ("stale", False), "d": ("retain", True), "e": ("stale", True)}
    assert tuple(S.stale_gate(plan).first()) == (3, 1, 2, 5, False)
    assert tuple(S.stale_gate(plan, at_least=2).first())[-1] is True
    safe = _chunks(spark, [("x", "https://p/9", "https://p/9#state=1", "", "", 0)])
    assert S.stale_plan(safe, fresh, spark.createDataFrame([("https://p/9",)], "url string")).first().action == "retain"


def test_three_way(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert tuple(S.removal_gate(S.three_way(ids(1, 2, 3, 4, 5), ids(1, 9), "id")).first()) == (1, 1, 4, True)
    assert tuple(S.removal_gate(S.three_way(ids(1, 2, 3), ids(1), "id")).first()) == (0, 1, 2, False)
    none = spark.createDataFrame([], "id int")
    assert tuple(S.removal_gate(S.three_way(none, none, "id")).first()) == (0, 0, 0, False)


def test_snapshots(spark):
    chunks = _chunks(spark, [("a", "https://P/1/", "", "h1", "", 2), ("b", "https://p/1", "", "h2", "", 5), ("c", "https://p/1", "https://p/1#state=X", "h3", "v", None)])
    got = {r.identity: (r.content_hash, r.is_variant) for r in S.current_state(chunks).collect()}
    assert got == {"https://p/1": ("h1", False), "https://p/1#state=x": ("h3", True)}
    assert {r.identity: r.refresh_count for r in S.refresh_counts(chunks).collect()} == {"https://p/1": 5, "https://p/1#state=x": 0}
    urls = spark.createDataFrame([("https://p/1",), ("https://p/none",)], "url string")
    assert S.chunks_of(chunks, urls).count() == 3 and [tuple(r) for r in S.deletion_counts(chunks, urls).collect()] == [("https://p/1", 3)]
    states = _chunks(spark, [("x", "https://p/1#state=a", "", "", "", 0), ("y", "https://q/1#state=a", "", "", "", 0)])
    assert {r.url for r in S.with_variants(states, urls).collect()} == {"https://p/1", "https://p/none", "https://p/1#state=a"}
    cache = spark.createDataFrame([("q1", ["https://P/1/"]), ("q2", ["https://x"]), ("q3", [])], "query string, source_urls array<string>")
    assert [r.query for r in S.invalidated(cache, urls).collect()] == ["q1"]
    assert S.new_only(urls.withColumnRenamed("url", "source_url"), chunks).count() == 1


def test_matched_pages(spark):
    urls, pages = spark.createDataFrame([("u/",), ("v",)], "url string"), spark.createDataFrame([("u", 1)], "url string, n int")
    assert sorted((r.url, r.n) for r in S.matched_pages(urls, pages).collect()) == [("u/", 1), ("v", None)]


def test_freshness(spark):
    health = {"live": "u1 u2 u3 u4 u9", "dead_404": "u5", "internal_redirect": "u6", "external_redirect": "u7", "timeout": "u8"}
    rows = [(f"https://p/{u}", s) for s, us in health.items() for u in us.split()]
    approved = spark.createDataFrame([(u,) for u, _ in rows], "url string")
    state = S.current_state(_chunks(spark, [("1", "https://p/u1", "", "h", "", 0), ("2", "https://p/u2", "", "h", "", 0), ("3", "https://p/u3", "", "h", "a", 0), ("4", "https://p/old", "", "h", "", 0), ("5", "https://p/u3", "https://p/u3#state=s", "h", "", 0), ("6", "https://p/u9", "", "h", "", 0)]))
    scraped = spark.createDataFrame([("https://p/u1", "", "h", ""), ("https://p/u2", "", "new", ""), ("https://p/u3", "", "h", "b"), ("https://p/u3", "https://p/u3#state=s", "h", ""), ("https://p/u4", "", "h", "")], "source_url string, dropdown_url string, content_hash string, video_url string")
    got = S.freshness(approved, spark.createDataFrame(rows, "url string, status string"), state, scraped)
    want = {"u1": "unchanged", "u2": "changed", "u3": "changed", "u4": "new", "u9": "scrape_failed", "u5": "removed_404", "u6": "removed_int_redir", "u7": "removed_ext_redir", "u8": "scrape_failed", "old": "removed_delisted"}
    assert {r.url.split("/")[-1]: r.action for r in got.collect()} == want
    assert [r.url for r in got.filter("video_changed").collect()] == ["https://p/u3"]
    assert tuple(S.freshness_breaker(got, state).first()) == (4, 5, 3, True)


def test_page_problems(spark):
    kind = "url string, variant string, title string, content string"
    long = "# Head\n" + "text " * 30
    new = spark.createDataFrame([("a", "", "T", "short"), ("b", "", "T", "short"), ("c", "", "My Page", "my page " + "x" * 120), ("d", "", "T", "no head " + "y" * 120), ("e", "", "", long + " Back to Top"), ("f", "v", "", "z" * 150), ("g", None, "", long), ("h", "", "", long)], kind)
    old = spark.createDataFrame([("b", "", "", "tiny"), ("f", "v", "", "z" * 400), ("gone", "", "", "x")], kind)
    got = sorted(tuple(r) for r in S.page_problems(new, old).collect())
    assert got == sorted([("ERROR", "a", "", "short"), ("WARN", "b", "", "short"), ("ERROR", "d", "", "no heading"), ("WARN", "e", "", "frame"), ("ERROR", "f", "v", "shrunk"), ("WARN", "gone", "", "missing"), ("WARN", "g", "", "identical")])


def test_gates(spark):
    docs = spark.createDataFrame([("u", "", ""), ("u", "", ""), ("v#state=1", "", "p"), ("w", "s", "")], "url string, dropdown_state string, parent_url string")
    assert tuple(S.scrape_problems(docs).first()) == (4, 1, 1, False)
    rows = spark.createDataFrame([("a", "2", 1), ("a", "1", 2), ("a", None, 3), ("b", "1", 4), ("", "1", 5), ("", "1", 6)], "h string, at string, id int")
    assert tuple(S.repetition(rows, F.col("h"), 0.5).first())[1:3] == (1, 2)
    got = {r.id: (r.survivor, r.is_victim) for r in S.survivors(rows.filter("h = 'a'"), F.col("h"), "at", "id").collect()}
    assert got == {1: (3, True), 2: (3, True), 3: (3, False)}
    assert tuple(S.failure_gate(rows, F.col("id") == 1, 0.1).first()) == (6, 1, pytest.approx(1 / 6), False)
    flags = S.duplicates_of(rows.select("id", "h"), F.col("h"), "id", "id").orderBy("id").collect()
    assert [(r.is_duplicate, r.duplicate_of) for r in flags] == [(False, ""), (True, "1"), (True, "1"), (False, ""), (False, ""), (True, "5")]


def test_promotion(spark):
    ix = spark.createDataFrame([(f"i{n}", 1000 if n < 5 else 100) for n in range(1, 6)], "name string, n_docs bigint")
    roles = lambda **k: {r.name: (r.role, r.reason) for r in S.promotion(ix, **k).collect()}
    assert roles(live="i4")["i5"] == ("kept", "shrink gate") and roles(live="i4")["i4"] == ("live", None)
    assert {n: r[0] for n, r in roles(live="i1", force=True, keep=2).items()} == {"i1": "kept", "i2": "dropped", "i3": "dropped", "i4": "kept", "i5": "promoted"}
    assert roles(live="i5")["i5"] == ("live", "already live") and S.promotion(ix, "i1", "nowhere").filter("reason IS NOT NULL").count() == 0


def test_answer_sheet(spark):
    kind = "_row int, id string, question string, answer string, intent string, advice_boundary string, active string, citation_1_title string, citation_1_url string, cta_4_label string, cta_4_url string"
    rows = [
        (2, None, "Fine?", "yes", None, "", None, "t", "https://ok.org/x", None, None),
        (3, "bad id", "", "x" * 251, "odd", "maybe", "y", "t", "http://ok.org", "l", "https://ok.org"),
        (4, None, "fine", "y" * 200, "direct", "true", "", "t", "", None, None),
        (5, None, "Off", "a", None, None, "NO", None, None, None, None),
        (6, "q-x", "Other", "", None, None, None, "t", "https://bad.com", None, None),
        (7, "q-x", "Third", "ok", None, None, None, None, None, None, None),
    ]
    got = {r["_row"]: (r.errors, r.warnings) for r in S.validate_answers(spark.createDataFrame(rows, kind), ["ok.org"]).collect()}
    assert got[2] == ([], []) and 5 not in got
    assert got[3][0] == ["question is empty", "answer is 251 chars, over the 250 limit", "intent is unknown", "advice_boundary must be true/false", "citation 1 url must be an absolute https url", "cta 4: at most 3 allowed", "id has invalid characters"]
    assert got[4] == (["citation 1: both title and url are required", "duplicate of row 2", "id already used in row 2"], ["answer is over the soft limit"])
    assert got[6][0] == ["answer is empty", "citation 1 url host is not allowed"] and got[7][0] == ["id already used in row 6"]


def test_apply(spark):
    table, rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    out = S.delete(S.upsert(table, rows, "k"), spark.createDataFrame([(1,)], "k int"), "k")
    assert sorted(map(tuple, out.collect())) == [(2, "c"), (3, "d")]
    with pytest.raises(S.Refused):
        S.upsert(table, rows.unionByName(rows), "k")
    with pytest.raises(RuntimeError):
        S.verify_count(out, 5)
    assert S.verify_search(out)
