from pyspark.sql import functions as F

from quillstone.functions import urls
from quillstone.operators import content, sync


def test_strip_html(spark):
    df = spark.createDataFrame([("<html><nav>menu</nav><p>One &amp; two</p><script>x()</script><!-- no -->\n<b>three</b></html>",), (None,)], "html string")
    assert [r[0] for r in df.select(content.strip_html(F.col("html"))).collect()] == ["One & two three", ""]


def test_changes(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, h string"), spark.createDataFrame([(2, "b"), (3, "x"), (4, "d")], "k int, h string")
    assert dict(map(tuple, content.changes(old, new, "k", "h").collect())) == {1: "deleted", 2: "same", 3: "changed", 4: "added"}


def test_upsert_replaces_by_key(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sync.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_urls(spark):
    rows = ["https://Example.com/a", "https://example.com:x@evil.com/a", "http://example.com/", "https://sub.example.com:8443/x?y", "https://notexample.com/", "", None, " https://A.com/X/?q#f "]
    df = spark.createDataFrame([(r,) for r in rows], "u string")
    u = F.col("u")
    assert [r[0] for r in df.select(urls.allowed_host(u, ["example.com"])).collect()] == [True, False, False, True, False, False, False, False]
    assert [r[0] for r in df.select(urls.canonical_url(u)).collect()][-2:] == ["", "https://A.com/x"]
    assert [r[0] for r in df.select(urls.host_lowered(u)).collect()][-1] == "https://a.com/X"
    assert [r[0] for r in df.select(urls.lowered_url(u)).collect()][-1] == "https://a.com/x/?q#f"
    one = spark.createDataFrame([("https://a.com/x/", " ", 100), ("https://a.com/x", "https://a.com/x#y/", 5000)], "u string, v string, n int")
    got = one.select(urls.identity(u, F.col("v")), urls.estimated_chunks(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("https://a.com/x", 1), ("https://a.com/x#y", 3)]


def test_url_rules(spark):
    df = spark.createDataFrame([("https://x.com/Pensions/webinars/a",), ("https://adviser.x.com/isa/",), ("https://x.com/help-and-support/employer/x",), ("https://x.com/",)], "u string")
    u = F.col("u")
    got = df.select(urls.section(u), urls.content_type(u), urls.product(u), urls.audience(u), urls.categorised_type(F.lit(" Product"), u), urls.is_dedicated(u)).collect()
    assert [tuple(r) for r in got] == [
        ("Pensions", "webinar", "pensions", "customer", "webinar", True),
        ("ISA", "article", "isa", "adviser", "article", True),
        ("General", "faq", "general", "employer", "faq", False),
        ("General", "article", "general", "customer", "article", False),
    ]


def test_health_and_redirects(spark):
    rows = [("https://x.com/a/b", "https://x.com/a/b/", 200, None), ("https://x.com/a/b", "https://x.com/a", 200, None), ("https://x.com/a/b", "https://y.com/z", 301, None)]
    rows += [("https://x.com/a/b", "https://y.com/a/c", 200, None), ("https://x.com/a", None, 410, None), ("https://x.com/a", None, 500, None), ("https://x.com/a", None, None, "timeout")]
    df = spark.createDataFrame(rows, "u string, f string, c int, e string")
    got = df.select(urls.health(F.col("c"), F.col("f"), F.col("u"), "x.com", F.col("e")), urls.redirect_reason(F.col("u"), F.col("f"))).collect()
    assert [r[0] for r in got] == ["live", "internal_redirect", "error", "external_redirect", "dead_404", "error", "timeout"]
    assert [r[1] for r in got][:4] == [None, "parent", "slug", "slug"]
    one = spark.createDataFrame([("https://x.com/new/a/b", "https://x.com/a/b", "Pension guide", "Cookie policy"), ("https://x.com/a", "https://x.com/a/a", "", "x")], "u string, f string, t string, l string")
    got = one.select(urls.redirect_reason(F.col("u"), F.col("f"), F.col("t"), F.col("l")), urls.slug_likeness(F.col("u"), F.col("f"))).collect()
    assert [tuple(r) for r in got] == [("restructured", 100.0), ("other", 100.0)]
