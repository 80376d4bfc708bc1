from pyspark.sql import functions as F

from quillstone.operators import markdown as M

HOST = "own.org"


def test_links(spark):
    cases = [("[a](https://out.com/x) b", "a b"), (f"[a](https://www.{HOST}/x) b", f"[a](https://www.{HOST}/x) b"), ("see https://out.com/x now", "see now"), (f"see https://{HOST}/x now", f"see https://{HOST}/x now"), (None, "")]
    df = spark.createDataFrame([(a,) for a, _ in cases], "t string")
    assert [r[0] for r in df.select(M.without_foreign_links(F.col("t"), HOST)).collect()] == [b for _, b in cases]


def test_cleaning(spark):
    body = "Body of the page, long enough to stay.\n"
    cases = ["1. [ Home ](u) >\n2. [ A ](u) >\n3. Section name here\n" + body, "Share\n * [](u)\n * ()\n" + body, body + "[Back to top](#x) y\nmore", body + "## Latest news\nold stuff", "Previous Item\n" + body + "\n\n\n\nx   \ny", body + "https://www.facebook.com/x z"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r[0] for r in df.select(M.cleaned(F.col("t"))).collect()]
    text = body.strip()
    assert got == [text, text, text + "\nmore", text, text + "\n\nx\ny", text + "\n z"]
    loss = df.select(*M.cleaning_losses(F.col("t"))).collect()
    assert loss[0].breadcrumb > 0 and loss[3].latest_news == len("## Latest news\nold stuff") and loss[0].second_copy == 0


def test_second_copies(spark):
    words = " ".join(f"w{i}" for i in range(150))
    cases = [f"# T\n{words}\n# T\n{words}", f"# T\n{words}\n# Other\n" + " ".join(f"v{i}" for i in range(150)), f"# T\nshort\n# T\n{words}", words]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(M.without_second_copy(F.col("t"))).collect()] == [f"# T\n{words}", *cases[1:]]


def test_cut_at(spark):
    df = spark.createDataFrame([("a" * 120 + " Please select one",), ("a" * 50 + " please select",), ("none",)], "t string")
    assert [len(r[0]) for r in df.select(M.cut_at(F.col("t"), ["select an option", "please select"])).collect()] == [120, 64, 4]


def test_accordions(spark):
    rows = [("p", i, k, t, n) for i, (k, t, n) in enumerate([("header", "What is it?", 10), ("prose", "a", 100), ("header", "How so", 9), ("prose", "b", 120), ("header", "Why", 3), ("prose", "c", 90), ("header", "Title", 5), ("prose", "d", 10), ("header", "Who?", 4), ("prose", "e", 3)])]
    got = M.accordion_runs(spark.createDataFrame(rows, "k string, pos int, type string, text string, n_chars int"), "k").collect()
    assert [(r.n, r.n_headers, r.consistent) for r in got] == [(3, 3, True)]


def test_sections_of_versions(spark):
    old, new = "# A\none two three\nsame\n# B\nx", "# A\none 2 three\nsame\n# C\ny"
    df = spark.createDataFrame([(1, old, new)], "k int, a string, b string")
    changes = M.section_changes(df.select("k", F.col("a").alias("t")), df.select("k", F.col("b").alias("t")), "k", "t")
    assert {(r.header, r.change) for r in changes.collect()} == {("# A", "modified"), ("# B", "removed"), ("# C", "added")}
    assert df.select(M.digest(F.lit("a  b\n\n c")) == M.digest(F.lit("a b\nc"))).first()[0]


def test_headings(spark):
    df = spark.createDataFrame([("intro\n### Fees\nx\n**Risks** y\nplain Costs",)], "t string")
    got = df.select(M.headings_found(F.col("t"), ["Fees", "Risks", "Costs"])).first()[0]
    assert [g.label for g in got] == ["Fees", "Risks"] and got[0].place < got[1].place
