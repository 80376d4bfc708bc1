from urllib.parse import quote

from pyspark.sql import functions as F

from quillstone.operators import markup as H

LONG = "A sentence that is repeated six times to make a page. " * 6
PAGE = f"""<html><head><title>T</title><meta name="description" content=" About it "><meta name="teaser_image" content="/t.png">
<meta name="st-publish-date" content="13 March 2024"><script>var x = 1;</script></head><body><nav>menu</nav><header>chrome</header>
<header class="hero big"><h1>Hero</h1></header><div>outside</div><main><h1>Title</h1><p>{LONG}</p><ul><li>one<li><a href="/u">two</a></ul>
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2 <b>x</b></td></tr></table><img src="i.png"><div class="sliderblock">w</div>
<div data-content="x">hidden</div></main><footer>foot</footer></body></html>"""


def tree(spark, *pages):
    return H.nodes(spark.createDataFrame([(i, h, "https://p") for i, h in enumerate(pages)], "page_id int, html string, url string"))


def markdown(spark, *pages):
    got = dict(map(tuple, H.markdown_of(H.content_nodes(tree(spark, *pages))).collect()))
    return [got.get(i, "") for i in range(len(pages))]


def test_nodes(spark):
    """Numbers, intervals and paths against the parser's own tree."""
    pages = [PAGE, "", None, "text only", "<p>a<p>b<br>c<div><ul><li>x<li>y</ul></div>tail" * 5]
    rows = {}
    for r in tree(spark, *pages).collect():
        rows.setdefault(r.page_id, []).append(r)
    assert set(rows) == {0, 3, 4}
    for i, found in rows.items():
        assert [r.pre for r in found] == list(range(1, len(found) + 1))
        by, root = {r.pre: r for r in found}, H.parse(pages[i])
        assert [r.tag for r in found if r.tag is not None] == [n.tag for n in root.walk()] and [r.text for r in found if r.tag is None] == list(root.strings())
        for r in found:
            assert r.depth == len(r.path) + 1 and (r.path[-1] if r.path else 0) == r.parent
            assert sorted(r.path) == sorted(e.pre for e in found if e.pre < r.pre <= e.last)
            assert r.last == max([r.pre, *(x.pre for x in found if r.pre in x.path)]) and (r.attrs is None) == (r.tag is None)
            assert not r.parent or by[r.parent].tag is not None


def test_main_content_and_markdown(spark):
    hero = "<body><header class='hero'><h1>Hero</h1></header><p>x</p></body>"
    md, plain, first, empty, bare, inner = markdown(spark, PAGE, hero, "<div class='content'>one</div><main>two</main>", "", "<p>a<p>b<br>c", "<nav><main>no</main></nav><main>yes<aside>no</aside></main>")
    assert md.startswith("# Title\n\nA sentence") and "* one\n* [two](/u)" in md and "| a | b |\n| --- | --- |\n| 1 | 2 **x** |" in md
    assert not any(w in md for w in ("menu", "foot", "hidden", "outside", "var x", "i.png", "sliderblock"))
    assert (plain, first, empty, bare, inner) == ("# Hero\n\nx", "one", "", "a\n\nb\nc", "yes")


def _dropdown(panels, options):
    opts = "".join(f"<option value='{v}'>{t}</option>" for v, t in [("", "Select..."), *options])
    return f"<main><select>{opts}</select>" + "".join(f"<div data-content='{k}'>{t}</div>" for k, t in panels) + "</main>"


def test_dropdowns(spark):
    texts = [("A", "Alpha has its own <b>words</b> and details here"), ("b ", "Beta says entirely other things about this"), ("c", "tiny"), ("a", "the second panel of that name is not read")]
    same = [("a", "the same words in another order here"), ("b", "here order another in words same the")]
    phones = [("a", "call us on the number that you know well"), ("b", "call us on the number that you know well")]
    pages = (
        _dropdown(texts, [("a", "First"), ("zz", "B"), ("c", "C"), ("d", "None")]), _dropdown(same, [("a", "A"), ("b", "B")]), _dropdown(phones, [("a", "A"), ("b", "B")]),
        _dropdown(texts, [("a", "First"), ("d", "None")]), _dropdown(texts[:2], [("a", "A b/ü~*"), ("b", "B")]).replace("value='b'", "value=''").replace("value='a'", "value='A é+/~*'"), "<p>none</p>",
    )
    t = tree(spark, *pages)
    urls = spark.range(len(pages)).selectExpr("int(id) AS page_id", "'https://p' AS url")
    got = {r.page_id: r for r in H.dropdowns(H.options(t), urls).collect()}
    assert [(s.dropdown_url, s.title, s.content) for s in got[0].states] == [("https://p#state=a", "First", "Alpha has its own words and details here"), ("https://p#state=zz", "B", "Beta says entirely other things about this")]
    assert got[1].states == [] and len(got[2].states) == 2 and [r.has_dropdown for _, r in sorted(got.items())] == [True, True, True, False, True, False]
    assert [(o.value, o.matched, o.n_chars) for o in got[3].options] == [("a", True, 40), ("d", False, 0)] and got[5].options == []
    coded = _dropdown([("x y/é~*", texts[0][1]), ("b", texts[1][1])], [("x y/é~*", "A"), ("b", "B")])
    state = H.dropdowns(H.options(tree(spark, coded)), urls.limit(1)).first().states[0].dropdown_url
    assert state == "https://p#state=" + quote("x y/é~*")


def test_videos_tabs_and_images(spark):
    frame = "<iframe src='' data-src='https://player.vimeo.com/video/1?h=abc'></iframe>"
    tabs = "<ul role='tablist'><li role='tab'>Fees</li><li role='tab'>Risks</li><li role='tab'>Home</li><li role='tab'>Fees</li></ul><div id='cookie-banner'><ul role='tablist'><li role='tab'>Consent</li></ul></div><div class='tabs x'><a>Links <i>too</i></a></div>"
    pages = ("", "<p>x</p>", frame, "<meta property='og:type' content='Video.other'>", "<meta name='Collection_name' content='Webinars'>", "<iframe src='https://x.com'>", tabs)
    df = spark.createDataFrame([(i, h, "https://p/videos/a" if i == 0 else "https://p/a") for i, h in enumerate(pages)], "page_id int, html string, url string")
    got = {r.page_id: r for r in H.read_pages(df).collect()}
    assert [got[i].has_video for i in range(7)] == [True, False, True, True, True, False, False]
    assert got[2].video_url == "https://player.vimeo.com/video/1?h=abc" and got[5].video_url == "" and got[6].tabs == ["Fees", "Risks", "Links too"] and got[1].tabs == []
    data = lambda x: f'<script type="application/ld+json">{x}</script>'
    block = '<figure id="image12"><img src="c.png"></figure>'
    css = '<div id="herobanner1"></div><style>.x{background-image: url(/a.png), url("/b-medium-1000x570.png");} .y{background-image: url(/c-medium-1000x570.png)}</style>'
    images = {
        data('{"image": ["/s.jpg", "/Large.jpg", "/z.jpg"]}'): "https://p/Large.jpg", data('[{"a": 1}, {"image": ["/s.jpg", "/z.jpg"]}]'): "https://p/z.jpg",
        data("not json") + data('{"image": {"url": "/x.jpg"}}') + data('{"image": "//cdn/y.jpg"}'): "https://cdn/y.jpg", data('{"image": "/generic/a.jpg"}') + block: "https://p/x/c.png",
        '<section><div id="FeatureBannerBlock7"><picture><source media="(x)" srcset="/m.jpg"><source srcset="https://q/w.jpg"></picture></div></section>': "https://q/w.jpg",
        '<div id="herobanner1"></div><div class="container"><source srcset="/no.jpg"></div>': None, block: "https://p/x/c.png", data('{"@type": "Article"}') + block: None,
        '<meta name="template" content="FeatureArticlePageType">' + block: None, "<p>none</p>": None, '<div id="image1"><img src="./d.gif"><img src="./e.png"></div><img src="f.png">': "https://p/x/e.png",
        css: "https://p/b-medium-1000x570.png",
    }
    pages = spark.createDataFrame([(i, h, "https://p/x/") for i, h in enumerate(images)], "page_id int, html string, url string")
    got = {r.page_id: r.image for r in H.page_images(H.nodes(pages), pages, generic=("generic",)).collect()}
    assert [got[i] for i in range(len(images))] == list(images.values())
    links = [("https://p/a/b?q", "c.png"), ("https://p", "c.png"), ("https://p/a", "/c"), ("https://p/a", "http://q/c")]
    df = spark.createDataFrame(links, "b string, l string")
    assert [r[0] for r in df.select(H.joined_url(F.col("b"), F.col("l"))).collect()] == ["https://p/a/c.png", "https://p/c.png", "https://p/c", "http://q/c"]


def test_page_rows(spark):
    rows = [(1, "https://p/a", PAGE, ""), (2, "https://p/b", "<meta name='description' content='Spare text'><main>x</main>", ""), (3, "https://p/c", "<meta name='description' content='d'><main>x</main>", "Information"), (4, "https://p/d", None, "")]
    got = {r.page_id: r for r in H.page_rows(spark.createDataFrame(rows, "page_id int, url string, html string, page_purpose string"), "page_purpose").collect()}
    assert got[1].problem is None and got[1].description == "About it" and got[1].publish_date == "2024-03-13" and got[1].content.startswith("# Title")
    assert got[2].content == "Spare text" and got[2].problem is None and got[3].problem == "too short" and got[4].problem == "empty response"
    html = _dropdown([("A", "Alpha has its own words and details here"), ("b", "Beta says entirely other things about this")], [("a", "First"), ("b", "B")])
    pages = H.page_rows(spark.createDataFrame([(1, "https://p/a", html + LONG * 3)], "page_id int, url string, html string"))
    assert sorted((r.dropdown_title, r.read_time_mins) for r in H.variant_rows(pages).collect()) == [("B", 1), ("First", 1)]


def test_columns(spark):
    df = spark.createDataFrame([('<META content="/x.png" name="teaser_image"><div id="app">', "not a date at all here")], "h string, d string")
    got = df.select(H.teaser_image(F.col("h")), H.markers(F.col("h")), H.published(F.col("d"))).first()
    assert got[0] == "/x.png" and len(got[1]) == 1 and got[2] == "not a date at all he"
    mins = spark.createDataFrame([(500,), (300,), (10,)], "n int").select(H.read_minutes(F.col("n")), H.variant_minutes(F.col("n"))).collect()
    assert [tuple(m) for m in mins] == [(2, 2), (2, 1), (1, 1)]
    kinds = spark.createDataFrame([(["Mr", "Mrs"], "u"), (["Newest"], "u"), (["A"], "https://p/bereavement"), (["A"], "https://p/news"), (["A"], "u")], "o array<string>, u string")
    assert [r[0] for r in kinds.select(H.dropdown_class(F.col("o"), F.col("u"))).collect()] == ["form_field", "content_filter", "contact_routing", "content_filter", "unknown"]
