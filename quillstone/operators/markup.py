"""Pages of HTML as tables of nodes: main content, metadata, dropdowns, tabs and images by windows, joins and aggregations over them.

A page is parsed once, in Arrow batches, into rows that are numbered in the order of the document, so that what lies in an element is an
interval of numbers. Only the parser, and the writer of markdown, look at one page at a time. The tree is the standard library's parser's, with the few repairs that pages need: void elements, and paragraphs, items, options, rows
and cells that end where the next one begins.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import materialise

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCKS = frozenset("p div section article main header footer ul ol table h1 h2 h3 h4 h5 h6 blockquote pre form".split())

#: What is no content, where content is, and widgets that change by themselves.
CHROME = ("nav", "header", "footer", "aside", "script", "style", "noscript")
CONTAINERS = {"tags": ("main", "article"), "classes": ("content", "page-content", "main-content"), "ids": ("content",), "roles": ("main",)}
WIDGETS = ("sliderblock", "dynamicsliderblock", "featuredcontentblock")
PLACEHOLDERS = (
    "select...", "select", "please select", "--", "choose...", "choose", "please choose", "-- select an option --", "- select -",
    "select an option", "select option", "none", "n/a", "0", "all", "select…",
)
VIDEO_HOSTS = ("player.vimeo.com", "youtube.com/embed", "players.brightcove.net")
VIDEO_PATHS = ("/webinars/", "/videos/", "/video/", "/webinar/")
VIDEO_COLLECTIONS = ("webinar", "video", "podcast")
VIDEO_SIGNS = (
    "video-player", "webinar-player", "brightcove-player", "bc-player", "vjs-tech", "kaltura-player", "jwplayer",
    "data-video-id", "data-webinar-id", "data-brightcove", "vimeoapi", "vimeovideoblock", "player.vimeo.com",
)
SPA_MARKERS = (
    r"id=[\"']app[\"']", r"id=[\"']root[\"']", "<app-root", "ng-version=", "data-reactroot", "__NEXT_DATA__",
    r"data-server-rendered=[\"']false[\"']", "ng-app",
)
HIDDEN_MARKERS = ("data-content=", "tab-panel", r"role=[\"']tabpanel[\"']", r"aria-hidden=[\"']true[\"']")
IMAGE_SIZES = ("medium-1000x570", "small-800x800", "large-1200x700")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self):
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack += reversed(node.children)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        ends = _CLOSES.get(tag, {"p"} if tag in _BLOCKS else set())
        node = self.at
        while node is not None and node.tag not in ("table", "ul", "ol", "select", "dl", "div", "section", "article", "main", "body"):
            if node.tag in ends:
                self.at = node.parent
            node = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def to_markdown(node: Node) -> str:
    """Headings with #, lists with * or numbers, links, emphasis and tables with pipes; images go; blocks are apart by one empty line."""
    out = re.sub(r"[ \t]*\n[ \t]*\n\s*", "\n\n", _block(node, 0))
    return out.strip()


def _inline(children, depth: int) -> str:
    return "".join(re.sub(r"\s+", " ", c) if isinstance(c, str) else _block(c, depth) for c in children)


def _block(n: Node, depth: int) -> str:
    tag = n.tag
    if tag in ("img", "script", "style", "noscript", "template"):
        return ""
    if tag == "br":
        return "\n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag in ("ul", "ol"):
        items = [c for c in n.children if isinstance(c, Node) and c.tag == "li"]
        mark = lambda i: f"{i}. " if tag == "ol" else "* "
        lines = ["  " * depth + mark(i) + re.sub(r"\n{2,}", "\n", _inline(c.children, depth + 1)).strip() for i, c in enumerate(items, 1)]
        return "\n" * (1 if depth else 2) + "\n".join(lines) + "\n" * (1 if depth else 2)
    if tag == "table":
        return _table(n)
    if tag == "pre":
        return "\n\n```\n" + "".join(n.strings()).strip("\n") + "\n```\n\n"
    inner = _inline(n.children, depth)
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        return f"\n\n{'#' * int(tag[1])} {inner.strip()}\n\n" if inner.strip() else ""
    if tag == "a" and n.attrs.get("href"):
        return f"[{inner.strip()}]({n.attrs['href']})"
    if tag in ("b", "strong", "i", "em", "code") and inner.strip():
        mark = {"b": "**", "strong": "**", "code": "`"}.get(tag, "*")
        return f"{mark}{inner.strip()}{mark}"
    if tag == "blockquote":
        return "\n\n" + "\n".join("> " + x for x in inner.strip().split("\n")) + "\n\n"
    return f"\n\n{inner.strip()}\n\n" if tag in _BLOCKS else inner


def _table(n: Node) -> str:
    rows = [[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
    cells = [[re.sub(r"\s+", " ", _inline(c.children, 0)).strip().replace("|", "\\|") for c in r] for r in rows if r]
    if not cells:
        return ""
    width = max(map(len, cells))
    line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
    return "\n\n" + "\n".join([line(cells[0]), line(["---"] * width), *map(line, cells[1:])]) + "\n\n"


# Nodes ----------------------------------------------------------------------------------------------------------------------------

_NODE = "pre int, last int, parent int, depth int, tag string, attrs map<string,string>, text string, path array<int>"
_ARROW = [("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("path", pa.list_(pa.int32()))]


def _numbered(root: Node) -> list[tuple]:
    """Nodes below root in the order of the document: number, the last number in its subtree, parent's number (0: root), depth, tag and attributes of an
    element or the text, and the numbers of the elements that it lies in."""
    rows: list[list] = []
    stack = [(c, 0, ()) for c in reversed(root.children)]
    while stack:
        node, parent, path = stack.pop()
        if node is None:  # the subtree of parent has ended
            rows[parent - 1][1] = len(rows)
            continue
        n = len(rows) + 1
        element = isinstance(node, Node)
        rows.append([n, n, parent, len(path) + 1, node.tag if element else None, list(node.attrs.items()) if element else None, None if element else node, list(path)])
        if element and node.children:
            stack.append((None, n, ()))
            stack += [(c, n, (*path, n)) for c in reversed(node.children)]
    return rows


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each element and each text of a page, from one parse, in Arrow batches: key, pre (place in the document, from 1), last (the greatest pre
    below it, or its own), parent, depth, tag and attrs (null for a text), text (null for an element), path (the elements it lies in, outermost first). A
    node lies in an element if its pre is above the element's and at most its last. Null or empty pages have no rows; keys must be unique."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                found = [_numbered(parse(h)) for h in part.column(1).to_pylist()]
                of = pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int32())
                rows = [r for rows in found for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), *(pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(_ARROW))], [key, *(n for n, _ in _ARROW)])

    return pages.select(key, F.coalesce(html, F.lit("")).alias("_h")).mapInArrow(run, f"{key} {kind}, {_NODE}")


def _attr(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def _classes() -> Column:
    return F.filter(F.split(_attr("class"), r"\s+"), lambda c: c != "")


def _named(names) -> Column:
    """Whether role or a class is one of names."""
    return _attr("role").isin(*names) | F.arrays_overlap(_classes(), F.array(*[F.lit(n) for n in names]))


def _within(key: str, what: Column) -> Column:
    """Whether a node is, or lies in, an element of the kind. Elements nest, so it does if the farthest end of those that began before reaches it."""
    return F.coalesce(F.max(F.when(what, F.col("last"))).over(Window.partitionBy(key).orderBy("pre")), F.lit(0)) >= F.col("pre")


def content_nodes(tree: DataFrame, key: str = "page_id") -> DataFrame:
    """The nodes of the content of each page: without chrome (a header of class hero stays), hidden panels and widgets, those below the first container in
    the order of the document, else below the body, else all."""
    c = CONTAINERS
    chrome = F.col("tag").isin(*CHROME) & ~((F.col("tag") == "header") & F.array_contains(_classes(), "hero"))
    gone = chrome | F.map_contains_key("attrs", F.lit("data-content")) | F.arrays_overlap(_classes(), F.array(*[F.lit(x) for x in WIDGETS]))
    kept = tree.withColumn("_gone", _within(key, F.coalesce(gone, F.lit(False)))).filter("NOT _gone").drop("_gone")
    holds = F.col("tag").isin(*c["tags"]) | F.arrays_overlap(_classes(), F.array(*[F.lit(x) for x in c["classes"]])) | _attr("id").isin(*c["ids"]) | _attr("role").isin(*c["roles"])
    place = F.struct("pre", "last")
    page = Window.partitionBy(key)
    kept = kept.withColumn("_c", F.coalesce(F.min(F.when(holds, place)).over(page), F.min(F.when(F.col("tag") == "body", place)).over(page)))
    return kept.filter(F.col("_c").isNull() | ((F.col("pre") > F.col("_c.pre")) & (F.col("pre") <= F.col("_c.last")))).drop("_c")


def markdown_of(content: DataFrame, key: str = "page_id") -> DataFrame:
    """key and markdown of content_nodes(): a page's nodes meet in one group, which a page bounds."""
    kind = content.schema[key].dataType.simpleString()

    def run(group, rows):
        root, made = Node("", {}, None), {}
        rows = rows.sort_by("pre")
        for pre, parent, tag, attrs, text in zip(*(rows.column(c).to_pylist() for c in ("pre", "parent", "tag", "attrs", "text")), strict=True):
            above = made.get(parent, root)
            if tag is None:
                above.children.append(text)
            else:
                made[pre] = Node(tag, dict(attrs), above)
                above.children.append(made[pre])
        return pa.table({key: pa.array([group[0].as_py()], rows.schema.field(key).type), "markdown": pa.array([to_markdown(root)], pa.string())})

    return content.select(key, "pre", "parent", "tag", "attrs", "text").groupBy(key).applyInArrow(run, f"{key} {kind}, markdown string")


def texts_of(tree: DataFrame, elements: DataFrame, key: str = "page_id") -> DataFrame:
    """elements (key, pre and other columns) with text (what is written in it, its strings trimmed and joined by blanks) and label (its strings as they are,
    trimmed). Texts meet the elements that they lie in by the numbers of these."""
    inner = tree.filter("tag IS NULL").select(key, F.col("pre").alias("_at"), "text", F.explode("path").alias("pre"))
    strings = F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"])  # of one element
    said = inner.join(elements.select(key, "pre").distinct(), [key, "pre"], "left_semi").groupBy(key, "pre").agg(strings.alias("_s"))
    text = F.array_join(F.filter(F.transform("_s", T.strip), lambda x: x != ""), " ")
    out = elements.join(said, [key, "pre"], "left").withColumn("_s", F.coalesce("_s", F.array().cast("array<string>")))
    return out.withColumn("text", text).withColumn("label", T.strip(F.array_join("_s", ""))).drop("_s")


def _meta(*wanted: tuple[str, str]) -> Column:
    """The content of the first of a page's meta elements with (attribute, value), in this order, whose content isn't blank."""
    out = []
    for name, value in wanted:
        this = (F.col("tag") == "meta") & (_attr(name) == value)
        out.append(F.nullif(T.strip(F.min_by(F.when(this, _attr("content")), F.when(this, F.col("pre")))), F.lit("")))
    return F.coalesce(*out, F.lit(""))


def facts(tree: DataFrame, key: str = "page_id") -> DataFrame:
    """key, description, teaser_image, og_image, publish_date, collection, og_type, video_url (the first address of a known host in a frame, lazily loaded
    ones first), n_words and n_visible (without what scripts and styles hold)."""
    hosts = "|".join(re.escape(h) for h in VIDEO_HOSTS)
    framed = F.coalesce(*[F.when(_attr(a).rlike(f"(?i){hosts}"), T.strip(_attr(a))) for a in ("data-src", "src", "data-lazy-src", "data-vimeo-src")])
    video = (F.col("tag") == "iframe") & framed.isNotNull()
    unseen = F.coalesce(F.col("tag").isin("script", "style", "noscript", "template"), F.lit(False))
    words = F.when(F.col("tag").isNull(), T.n_words(F.col("text"))).otherwise(0)
    rows = tree.withColumn("_unseen", _within(key, unseen)).withColumn("_words", words)
    return rows.groupBy(key).agg(
        F.substring(_meta(("name", "description"), ("property", "og:description"), ("name", "st-description")), 1, 300).alias("description"),
        _meta(("name", "teaser_image")).alias("teaser_image"), _meta(("property", "og:image")).alias("og_image"), _meta(("name", "st-publish-date")).alias("publish_date"),
        F.substring(_meta(("name", "Collection_name")), 1, 100).alias("collection"),
        F.lower(_meta(("name", "Collection_name"), ("name", "collection_name"), ("property", "Collection_name"))).alias("_collection"), F.lower(_meta(("property", "og:type"))).alias("_type"),
        F.coalesce(F.min_by(F.when(video, framed), F.when(video, F.col("pre"))), F.lit("")).alias("video_url"),
        F.sum("_words").cast("int").alias("n_words"), F.sum(F.when(~F.col("_unseen"), F.col("_words")).otherwise(0)).cast("int").alias("n_visible"),
    )


def has_video(html: Column, url: Column, collection: Column, og_type: Column) -> Column:
    """A path of videos, a collection or type (lower case) that says so, or the signs of a player."""
    low, path = F.lower(F.coalesce(html, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    out = T.has_any(path, VIDEO_PATHS) | T.has_any(collection, VIDEO_COLLECTIONS) | og_type.contains("video") | T.has_any(low, VIDEO_SIGNS)
    return F.coalesce(out, F.lit(False))


def _of_first(key: str, what: Column) -> Column:
    """pre of the nearest element of the kind that began before a node and holds it, else null. Elements of the kind don't nest."""
    page = Window.partitionBy(key).orderBy("pre")
    nearest = F.last(F.when(what, F.struct("pre", "last")), ignorenulls=True).over(page)
    return F.when(nearest["last"] >= F.col("pre"), nearest["pre"])


def options(tree: DataFrame, key: str = "page_id") -> DataFrame:
    """key, select (its pre), pre, value, label, real (it has a label, and isn't a placeholder), panel and n_chars: the pre of the panel of that value, and the
    length of its text, and panel_text: of that panel, else of the one that the label names. A panel is the first element whose data-content has the name."""
    panels = tree.withColumn("name", F.lower(T.strip(F.try_element_at("attrs", F.lit("data-content"))))).filter("name IS NOT NULL")
    panels = texts_of(tree, panels.groupBy(key, "name").agg(F.min("pre").alias("pre")), key).select(key, "name", F.col("pre").alias("panel"), F.col("text").alias("said"))
    found = tree.withColumn("select", _of_first(key, F.col("tag") == "select")).filter("tag = 'option' AND select IS NOT NULL")
    found = texts_of(tree, found.select(key, "select", "pre", _attr("value").alias("value")), key).drop("text")
    by = lambda c: panels.select(key, F.col("name").alias(c), F.col("panel").alias(f"{c}_panel"), F.col("said").alias(f"{c}_text"))
    named = lambda c: F.nullif(F.lower(T.strip(F.col(c))), F.lit(""))
    found = found.withColumns({"_v": named("value"), "_l": named("label")}).join(by("_v"), [key, "_v"], "left").join(by("_l"), [key, "_l"], "left")
    real = (F.col("label") != "") & ~F.lower("label").isin(*PLACEHOLDERS)
    return found.select(
        key, "select", "pre", "value", "label", real.alias("real"), F.col("_v_panel").alias("panel"), F.coalesce(F.length("_v_text"), F.lit(0)).alias("n_chars"),
        F.coalesce("_v_text", "_l_text").alias("panel_text"),
    )


_PHONES = r"[01]\d{3,4}[\s\-]?\d{3,4}[\s\-]?\d{3,4}"
#: Phrases of contact details.
CONTACT = (
    "call us", "write to us", "lines are open", "excluding bank holidays", "fill in our online form", "tell us someone has died",
    "fill out our online form", "monday to friday", "8am to", "9am to",
)


def word_set(text: Column, most: int = 200) -> Column:
    return F.array_distinct(F.slice(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), 1, most))


def varies(sets: Column, limit: float = 0.65) -> Column:
    """Whether any two of the sets of words, of the panels of one select, share less than limit of their words."""

    def alike(a, b):
        both = F.size(F.array_intersect(a, b))
        return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)

    return F.exists(F.transform(sets, lambda a, i: F.exists(F.slice(sets, i + 2, F.size(sets)), lambda b: alike(a, b) < limit)), lambda x: x)


def has_contact(text: Column) -> Column:
    return T.has_any(F.lower(text), CONTACT) | text.rlike(_PHONES)


def _listed(column: Column, order: str) -> Column:
    """An array of the rows of a group, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), column.alias("v")))), lambda x: x["v"])


_STATES = "array<struct<dropdown_url:string,value:string,title:string,content:string>>"
_OPTIONS = "array<struct<value:string,label:string,matched:boolean,n_chars:int>>"


def dropdowns(found: DataFrame, urls: DataFrame, key: str = "page_id") -> DataFrame:
    """key, states, options and has_dropdown of options(). urls: key and url. A select with two or more real options, of which two or more lead to texts of 20
    characters or more, has states, if these texts differ or one has contact details: url of the state, value, title and content. options: all that have a
    value, with whether a panel has it."""
    hits = found.filter("real AND length(panel_text) >= 20").join(urls.select(key, F.coalesce("url", F.lit("")).alias("url")), key)
    code = F.replace(F.url_encode(F.coalesce(F.nullif("value", F.lit("")), F.col("label"))), F.lit("+"), F.lit("%20"))
    for coded, plain in (("%2F", "/"), ("%7E", "~")):
        code = F.replace(code, F.lit(coded), F.lit(plain))
    code = F.replace(code, F.lit("*"), F.lit("%2A"))
    state = F.struct(F.concat("url", F.lit("#state="), code).alias("dropdown_url"), "value", F.col("label").alias("title"), F.col("panel_text").alias("content"))
    selects = hits.groupBy(key, "select").agg(_listed(state, "pre").alias("s"), F.collect_list(word_set(F.col("panel_text"))).alias("w"), F.bool_or(has_contact(F.col("panel_text"))).alias("c"))
    states = selects.filter((F.size("s") >= 2) & (varies(F.col("w")) | F.col("c"))).groupBy(key).agg(F.flatten(_listed(F.col("s"), "select")).alias("states"))
    said = F.struct(T.strip(F.col("value")).alias("value"), "label", F.col("panel").isNotNull().alias("matched"), "n_chars")
    valued = T.strip(F.col("value")) != ""
    many = found.filter("real").groupBy(key, "select").count().groupBy(key).agg((F.max("count") > 1).alias("has_dropdown"))
    listed = found.filter(valued).groupBy(key).agg(_listed(said, "pre").alias("options"))
    out = urls.select(key).join(states, key, "left").join(listed, key, "left").join(many, key, "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).cast(kind).alias(c)
    return out.select(key, none("states", _STATES), none("options", _OPTIONS), F.coalesce("has_dropdown", F.lit(False)).alias("has_dropdown"))


#: Tabs: roles and classes of lists and items, labels that belong to other things, and the lengths of a label (both excluded).
TABS = {"lists": ("tablist", "tabs", "nav-tabs", "tab-list"), "items": ("tab", "nav-link", "tab-item"), "not": ("home", "menu", "search", "login", "next", "previous"), "cookie": ("cookie", "consent", "privacy", "vendor", "purpose"), "lengths": (2, 60)}


def tab_labels(tree: DataFrame, key: str = "page_id", how: dict = TABS) -> DataFrame:
    """key and tabs: the labels of the tabs of the page's content, each once; those of cookie banners and navigation are none. A list without items of the
    kind has its links as items. Pages without tabs have no row."""
    low, high = how["lengths"]
    cookie = T.has_any(F.lower(F.concat_ws(" ", _attr("id"), _attr("class"))), how["cookie"])
    element = F.col("tag").isNotNull()
    groups = tree.withColumn("_c", _within(key, element & cookie)).filter(element & _named(how["lists"]) & ~F.col("_c")).select(key, F.col("pre").alias("group"))
    items = tree.filter(element & (_named(how["items"]) | (F.col("tag") == "a"))).select(key, "pre", _named(how["items"]).alias("item"), F.explode("path").alias("group")).join(groups, [key, "group"])
    items = items.withColumn("_any", F.max("item").over(Window.partitionBy(key, "group"))).filter("item OR NOT _any")
    said = texts_of(tree, items, key).withColumn("_low", F.lower("text"))
    fine = (F.length("text") > low) & (F.length("text") < high) & ~F.col("_low").isin(*how["not"]) & ~T.has_any(F.col("_low"), how["cookie"])
    said = said.filter(fine).withColumn("_o", F.struct("group", "pre"))
    return said.groupBy(key).agg(F.array_distinct(_listed(F.col("text"), "_o")).alias("tabs"))


# Images ---------------------------------------------------------------------------------------------------------------------------

#: Ids of banners and of image blocks, endings of pictures, and the type of page that is an article.
BANNER, IMAGE_BLOCK, PICTURE, ARTICLE = r"(?i)^(feature|hero)banner(block)?\d+$", r"(?i)^image\d+$", r"(?i)\.(jpg|jpeg|png|webp)$", "FeatureArticlePageType"
_URLS = r"""(?i)background-image:[^;}]*url\(\s*['"]?([^'")]+)"""  # the last address of each declaration


def _first(value: Column, order: Column, when: Column) -> Column:
    """The value of the first row of a group for which `when` holds."""
    return F.min_by(F.when(when, value), F.when(when, order))


def linked_images(tree: DataFrame, key: str = "page_id", generic: tuple[str, ...] = ()) -> DataFrame:
    """key, image and article of a page's linked data: the first image that isn't generic, in the order of the document (of a list a large one, else the last),
    and whether a block describes an article. Blocks that aren't JSON say nothing."""
    scripts = tree.filter((F.col("tag") == "script") & F.lower(_attr("type")).contains("application/ld+json")).select(key, "pre")
    rows = texts_of(tree, scripts, key).select(key, "pre", F.posexplode(F.from_json("label", "array<struct<image:string,`@type`:string>>")).alias("at", "d"))
    many = F.from_json("d.image", "array<string>")
    large = F.filter(many, lambda x: F.lower(x).contains("large"))
    one = F.when(F.col("d.image").startswith("["), F.coalesce(F.get(large, 0), F.try_element_at(many, F.lit(-1)))).when(~F.col("d.image").startswith("{"), F.col("d.image"))
    rows = rows.withColumn("image", F.nullif(one, F.lit("")))
    fine = F.col("image").isNotNull() & ~F.coalesce(T.has_any(F.lower("image"), generic), F.lit(False))
    return rows.groupBy(key).agg(_first(F.col("image"), F.struct("pre", "at"), fine).alias("image"), F.bool_or(F.coalesce(F.col("d.`@type`") == "Article", F.lit(False))).alias("article"))


def page_images(tree: DataFrame, urls: DataFrame, key: str = "page_id", generic: tuple[str, ...] = ()) -> DataFrame:
    """key and image of every page of urls (key, url): of its linked data, else of its banner, else, unless it is an article, of its first image block;
    absolute, null where there is none. Generic ones don't count.

    A banner's region is its element and what follows in the same parent, up to a div of class container; there, a source of a picture counts before one
    for some media only, and that before a background, of which one of IMAGE_SIZES comes first. In a block, an img comes after the sources."""
    page = Window.partitionBy(key).orderBy("pre")
    rows = tree.withColumn("_parent_last", F.max("last").over(Window.partitionBy(key)))
    ends = tree.select(key, F.col("pre").alias("parent"), F.col("last").alias("_of"))
    rows = rows.join(ends, [key, "parent"], "left").withColumn("_end", F.coalesce("_of", "_parent_last"))
    begins = lambda pattern: F.first(F.when(_attr("id").rlike(pattern), F.struct("pre", "last", F.col("_end").alias("end"))), ignorenulls=True).over(page)
    rows = rows.withColumn("_banner", begins(BANNER)).withColumn("_block", begins(IMAGE_BLOCK))
    stop = (F.col("tag") == "div") & F.array_contains(_classes(), "container") & (F.col("pre") > F.col("_banner.pre"))
    rows = rows.withColumn("_stopped", F.coalesce(F.max(stop.cast("int")).over(page), F.lit(0)) == 1)
    inside = (F.col("pre") >= F.col("_banner.pre")) & (F.col("pre") <= F.col("_banner.end")) & ~F.col("_stopped")
    rows = rows.withColumn("_in", F.coalesce(inside, F.lit(False))).withColumn("_under", F.coalesce(F.col("pre") <= F.col("_block.last"), F.lit(False)))
    rows = rows.withColumn("_style", F.col("text").isNotNull() & F.coalesce(F.lag("tag").over(page) == "style", F.lit(False)))
    css = F.when(F.col("_style"), F.col("text")).otherwise(_attr("style"))
    source = F.when((F.col("tag") == "source") & _attr("srcset").rlike(PICTURE), _attr("srcset"))
    image = F.when((F.col("tag") == "img") & _attr("src").rlike(PICTURE), _attr("src"))
    backs = F.regexp_extract_all(css, F.lit(_URLS), F.lit(1))
    ranked = F.when(source.isNotNull(), F.array(F.struct(F.when(F.map_contains_key("attrs", F.lit("media")), 1).otherwise(0).alias("rank"), source.alias("url"))))
    ranked = ranked.when(F.col("_under") & image.isNotNull(), F.array(F.struct(F.lit(50).alias("rank"), image.alias("url"))))
    by_size = lambda u: F.coalesce(*[F.when(u.contains(x), F.lit(10 + i)) for i, x in enumerate(IMAGE_SIZES)], F.lit(20))
    ranked = ranked.otherwise(F.transform(backs, lambda u: F.struct(by_size(u).alias("rank"), u.alias("url"))))
    seen = rows.filter("_in OR _under").select(key, "pre", "_in", "_under", F.posexplode(ranked).alias("i", "p"))
    fine = ~F.coalesce(T.has_any(F.lower("p.url"), generic), F.lit(False))
    order = F.struct("p.rank", "pre", "i")
    backdrop = F.col("p.rank").between(10, 20)
    found = seen.groupBy(key).agg(_first(F.col("p.url"), order, F.col("_in") & (F.col("p.rank") < 50) & fine).alias("banner"), _first(F.col("p.url"), order, F.col("_under") & ~backdrop & fine).alias("block"))
    articles = tree.filter((F.col("tag") == "meta") & (_attr("name") == "template") & (_attr("content") == ARTICLE)).select(key, F.lit(True).alias("_template")).distinct()
    out = urls.select(key, "url").join(linked_images(tree, key, generic), key, "left").join(found, key, "left").join(articles, key, "left")
    block = F.when(~F.coalesce("article", F.lit(False)) & F.col("_template").isNull(), F.col("block"))
    return out.select(key, joined_url(F.coalesce("url", F.lit("")), F.coalesce("image", "banner", block)).alias("image"))


def joined_url(base: Column, link: Column) -> Column:
    """link as seen from base: absolute links as they are, then by scheme, host or folder."""
    scheme, host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    out = F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(host, link))
    return out.otherwise(F.concat(host, folder, F.regexp_replace(link, r"^(\./)+", "")))


# Pages ----------------------------------------------------------------------------------------------------------------------------


def read_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """All that is read off pages (key, url, html), from one table of their nodes, which is written: a row for each page."""
    tree = materialise(nodes(pages, key), "nodes")
    page = pages.select(key, F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    found = facts(tree, key)
    parts = [markdown_of(content_nodes(tree, key), key), dropdowns(options(tree, key), page, key), tab_labels(tree, key), page_images(tree, page, key)]
    out = page.join(found, key, "left")
    for part in parts:
        out = out.join(part, key, "left")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    video = has_video(F.col("html"), F.col("url"), F.coalesce("_collection", F.lit("")), F.coalesce("_type", F.lit("")))
    return out.select(
        key, *map(text, ("markdown", "description", "teaser_image", "og_image", "publish_date", "collection", "video_url")), count("n_words"), count("n_visible"), video.alias("has_video"),
        F.coalesce("tabs", F.array().cast("array<string>")).alias("tabs"), "states", "options", "has_dropdown", "image",
    )


def published(raw: Column) -> Column:
    """A date like 13 March 2024 as 2024-03-13; what isn't one, its first 20 characters."""
    day = F.try_to_timestamp(F.nullif(raw, F.lit("")), F.lit("d MMMM yyyy"))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.substring(raw, 1, 20))


def read_minutes(n_words: Column) -> Column:
    """Minutes to read a page at 200 words each, halves to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(n_words / 200).cast("int"))


def variant_minutes(n_words: Column) -> Column:
    """Of a variant of a page: whole minutes only, at least 1."""
    return F.greatest(F.lit(1), F.floor(n_words / 200).cast("int"))


def markers(html: Column, patterns: tuple[str, ...] = SPA_MARKERS) -> Column:
    """The patterns that occur in a page's source, in any case."""
    return F.array_compact(F.array(*[F.when(html.rlike(f"(?i){p}"), F.lit(p)) for p in patterns]))


def teaser_image(html: Column) -> Column:
    """The teaser image named in the page's head, whatever the order of the attributes."""
    tag = r"(?i)<meta\b(?=[^>]*\bname=[\"']teaser_image[\"'])(?=[^>]*\bcontent=[\"']([^\"']+)[\"'])[^>]*>"
    return F.nullif(T.strip(F.regexp_extract(html, tag, 1)), F.lit(""))


def page_rows(pages: DataFrame, purpose: str | None = None, key: str = "page_id") -> DataFrame:
    """pages (a unique key, url, html and other columns, which are kept) with content, problem (null, empty response, too short or too short after
    cleaning), content_hash and the columns of read_pages(). Content of less than 100 characters, or of less than 50 after cleaning, is replaced by
    the description, unless the column purpose says information."""
    from .markdown import cleaned

    low = F.lower(F.trim(F.coalesce(F.col(purpose), F.lit("")))) if purpose else F.lit("")
    got = pages.join(read_pages(pages, key), key)
    got = got.withColumn("_clean", cleaned(F.col("markdown")))
    thin = F.when(F.length(T.strip(F.col("markdown"))) < 100, "too short").when(F.length("_clean") < 50, "too short after cleaning")
    got = got.withColumn("problem", F.when(F.coalesce("html", F.lit("")) == "", "empty response").otherwise(thin))
    spare = F.col("problem").isNotNull() & (F.col("problem") != "empty response") & (low != "information") & (F.col("description") != "")
    got = got.withColumn("content", F.when(spare, F.col("description")).when(F.col("problem").isNull(), F.col("_clean")))
    got = got.withColumn("problem", F.when(spare, None).otherwise(F.col("problem"))).withColumn("content_hash", F.sha2("content", 256))
    return got.withColumns({"publish_date": published(F.col("publish_date")), "read_time_mins": read_minutes(F.col("n_words"))}).drop("_clean", "markdown")


def variant_rows(rows: DataFrame) -> DataFrame:
    """A row for each state of the dropdowns of page_rows()'s result: its dropdown_url, dropdown_title, content, hash and reading time."""
    keep = [c for c in rows.columns if c not in ("states", "content", "content_hash", "read_time_mins")]
    out = rows.select(*keep, F.explode("states").alias("_s")).withColumns({"dropdown_url": F.col("_s.dropdown_url"), "dropdown_title": F.col("_s.title"), "content": F.col("_s.content")})
    return out.withColumns({"content_hash": F.sha2("content", 256), "read_time_mins": variant_minutes(T.n_words(F.col("content")))}).drop("_s")


def page_hash(markdown: Column, own_host: str) -> Column:
    """The hash by which a change of a page is seen: of its markdown, cleaned, without foreign links."""
    from .markdown import cleaned, without_foreign_links

    return F.sha2(without_foreign_links(cleaned(markdown), own_host), 256)


def variant_hash(text: Column, own_host: str) -> Column:
    from .markdown import without_foreign_links

    return F.sha2(without_foreign_links(text, own_host), 256)


def dropdown_class(labels: Column, url: Column) -> Column:
    """form_field with two words of forms, content_filter with one of filters or by url, contact_routing by url, else unknown."""
    joined, low = F.lower(F.array_join(labels, " ")), F.lower(F.coalesce(url, F.lit("")))
    n = lambda words: sum((joined.contains(w).cast("int") for w in words), F.lit(0))
    form = ("mr", "mrs", "ms", "miss", "other", "title", "first name", "last name", "date of birth")
    filters = ("filter by", "category", "years", "months", "newest", "oldest", "sort by", "results", "page 1 of")
    listing, contact = ("/life-events", "/retirement-guidance", "/guides-tools", "/news", "/blog"), ("/contact", "/bereavement", "/make-a-claim", "/help-and-support")
    out = F.when(n(form) >= 2, "form_field").when(n(filters) >= 1, "content_filter").when(T.has_any(low, listing), "content_filter")
    return out.when(T.has_any(low, contact), "contact_routing").otherwise("unknown")
