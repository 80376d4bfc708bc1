"""Elements, tables, sections and chunks of pages of markdown, from their lines.

A page's lines become rows with positions. What a line is depends on lines before it only through runs: a fence opens or closes by its
parity, a list or a table goes on while its lines do. So runs are gaps and islands, elements, sections and blocks are running sums, and
all windows are over one page: the lines are shuffled once, by the key of their page, which must be unique. A block that is too long is
split by a fold over its parts. Nothing leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import rough_chunks
from .markdown import LEAST, OVERLAP, SEPARATORS, SIZE, TABLE_ROWS, without_foreign_links

_ENDS = "\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029"
_BREAK = f"(?:\\r\\n|[{_ENDS}])"
_LIST = r"(?U)^([-*+]|\d+\.)\s"


def _count(what: Column) -> Column:
    return what.cast("int")


def lines(pages: DataFrame, key: str, content: str) -> DataFrame:
    """key, pos (from 0), raw (with its break), line (without), bare (trimmed) and at (characters before it). Null is an empty page, without lines."""
    found = F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(f"([^{_ENDS}]*{_BREAK}|[^{_ENDS}]+)"), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("pos", "raw"))
    rows = rows.withColumn("line", F.regexp_replace("raw", f"{_BREAK}$", "")).withColumn("bare", T.strip(F.col("line")))
    before = Window.partitionBy(key).orderBy("pos")
    return rows.withColumn("at", F.sum(F.length("raw")).over(before) - F.length("raw"))


def marked(pages: DataFrame, key: str, content: str, typed: bool = False) -> DataFrame:
    """lines() with type, level (of headers, else 0), starts (whether an element begins) and element (its number from 0).

    A header is a line by itself, and so is an empty one. A table begins at a line with a pipe in front and another, and goes on while lines have
    one in front. Everything else is prose, up to the next element or a line with a pipe in front. With typed, there are also code (from a fence to the
    next, or to the end), lists (from an item on, items and indented lines), and headers up to level 4 only; a line with # in front ends prose."""
    page = Window.partitionBy(key).orderBy("pos")
    bare, pipe = F.col("bare"), F.col("bare").startswith("|")
    level = F.length(F.regexp_extract("bare", r"(?U)^(#{1,6})\s", 1))
    rows = lines(pages, key, content).withColumn("level", F.when(level <= 4, level).otherwise(0) if typed else level)
    rows = rows.withColumns({"code": F.lit(False), "opens": F.lit(False), "listed": F.lit(False)})
    if typed:
        fence = bare.startswith("```")
        rows = rows.withColumn("odd", F.sum(_count(fence)).over(page) % 2 == 1).withColumn("code", fence | F.col("odd")).withColumn("opens", fence & F.col("odd"))
        item = bare.rlike(_LIST)
        rows = rows.withColumn("goes", ~F.col("code") & (bare != "") & (item | F.col("line").rlike(r"(?U)^\s"))).withColumn("run", F.sum(_count(~F.col("goes"))).over(page))
        rows = rows.withColumn("listed", F.col("goes") & (F.max(_count(F.col("goes") & item)).over(Window.partitionBy(key, "run").orderBy("pos")) == 1))
    free = ~F.col("code") & ~F.col("listed")
    rows = rows.withColumn("piped", pipe & free).withColumn("run", F.sum(_count(~F.col("piped"))).over(page))
    begun = F.max(_count(F.col("piped") & (F.locate("|", bare, 2) > 0))).over(Window.partitionBy(key, "run").orderBy("pos"))
    rows = rows.withColumn("tabled", F.col("piped") & (begun == 1)).withColumn("level", F.when(free, F.col("level")).otherwise(0))
    kind = F.when(F.col("code"), "code").when(F.col("listed"), "list").when(F.col("level") > 0, "header").when(F.col("tabled"), "table").when(bare == "", "blank").otherwise("prose")
    rows = rows.withColumn("type", kind)
    breaks = pipe | bare.startswith("#") if typed else pipe
    anew = F.col("type").isin("header", "blank") | F.col("opens") | ((F.col("type") == "prose") & breaks)
    rows = rows.withColumn("starts", anew | F.coalesce(F.lag("type").over(page) != F.col("type"), F.lit(True)))
    rows = rows.withColumn("element", F.sum(_count(F.col("starts"))).over(page) - 1)
    return rows.select(key, "pos", "raw", "line", "bare", "at", "type", "level", "starts", "element")


def _joined(column: str, by: str = "\n") -> Column:
    """The lines of a group, in order: of a page at most."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", column))), lambda x: x[column]), by)


def _title() -> Column:
    return T.strip(F.regexp_replace("bare", r"(?U)^#{1,6}\s+", ""))


def elements(pages: DataFrame, key: str, content: str, typed: bool = False) -> DataFrame:
    """key, element, type, level (of headers, else null), first (line from 0), n_lines, n_chars (without breaks) and text: of a header what follows the
    marks, else its lines."""
    rows = marked(pages, key, content, typed)
    out = rows.groupBy(key, "element").agg(
        F.first("type").alias("type"), F.max("level").alias("level"), F.min("pos").alias("first"), F.count("*").cast("int").alias("n_lines"),
        F.sum(F.length("line")).cast("int").alias("n_chars"), _joined("line").alias("text"), F.first(_title()).alias("_title"),
    )
    header = (F.col("type") == "header") & F.lit(not typed)
    return out.withColumn("text", F.when(header, F.col("_title")).otherwise(F.col("text"))).withColumn("level", F.when(header, F.col("level"))).drop("_title")


def _cells(bare: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(bare, r"^\|+|\|+$", ""), r"\|"), T.strip)


def _is_rule(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c == "") | c.rlike("^[-:]+$"))


def tables(pages: DataFrame, key: str, content: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, first (line), start and end (characters, the last break included), n_rows, n_columns, n_chars and split, of each table: whether the end of one of the
    windows of size, every size - overlap, falls inside. The first line is the header unless it is a rule; rules are no rows."""
    rows = marked(pages, key, content).filter("type = 'table'").withColumn("cells", _cells(F.col("bare"))).withColumn("rule", _is_rule(F.col("cells")))
    wide = F.size("cells")
    out = rows.groupBy(key, "element").agg(
        F.min("pos").alias("first"), F.min("at").alias("start"), F.max(F.col("at") + F.length("raw")).alias("end"), F.count_if(~F.col("rule")).alias("_n"),
        F.min_by("rule", "pos").alias("_ruled"), F.min_by(wide, "pos").alias("_header"), F.max(F.when(~F.col("rule"), wide)).alias("_widest"), F.sum(F.length("line")).cast("int").alias("n_chars"),
    )
    step = size - overlap
    end = F.greatest(F.lit(0), F.floor((F.col("start") - size) / step) + 1) * step + size
    return out.select(
        key, "first", "start", "end", (F.col("_n") - F.when(F.col("_ruled"), 0).otherwise(1)).cast("int").alias("n_rows"),
        F.coalesce(F.when(F.col("_ruled"), F.col("_widest")).otherwise(F.col("_header")), F.lit(0)).alias("n_columns"), "n_chars", (end < F.col("end")).alias("split"),
    )


# Splitting ------------------------------------------------------------------------------------------------------------------------

_STATE = "struct<out:array<string>,held:array<struct<t:string,e:int>>,at:int>"


def split_text(text: Column, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """text in pieces of at most size characters, trimmed, none empty. It is cut before each separator; parts are put together while they fit, and the last
    of them, up to overlap, begin the next piece; a part that is still too long is split in the same way at the separators after. The empty separator, for
    which any place will do, is a window that moves on by size - overlap."""
    if not separators:
        return F.array(text)
    first, rest = separators[0], separators[1:]
    if first == "":
        step = size - min(overlap, size - 1)
        starts = lambda t: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.length(t) - size) / step)).cast("int"))
        windows = T.bound(text, lambda t: F.transform(starts(t), lambda k: T.strip(F.substring(t, k * step + 1, F.lit(size)))))
        return F.filter(windows, lambda p: p != "")
    cut = F.transform(F.split(text, re.escape(first), -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(first), p)))
    closed = lambda held: F.filter(F.array(T.strip(F.array_join(F.transform(held, lambda h: h["t"]), ""))), lambda p: p != "")
    state = lambda out, held, at: F.struct(out.alias("out"), held.alias("held"), at.alias("at"))
    none = F.array().cast("array<struct<t:string,e:int>>")

    def step_on(s, part):
        n = F.length(part)
        end = s["at"] + n
        length = F.when(F.size(s["held"]) > 0, s["at"] - F.get(s["held"], 0)["e"] + F.length(F.get(s["held"], 0)["t"])).otherwise(0)
        mine = F.array(F.struct(part.alias("t"), end.alias("e")))
        kept = F.filter(s["held"], lambda h: s["at"] - h["e"] + F.length(h["t"]) <= F.least(F.lit(overlap), F.lit(size) - n))
        full = (length + n > size) & (F.size(s["held"]) > 0)
        return (
            F.when(n > size, state(F.concat(s["out"], closed(s["held"]), split_text(part, size, overlap, rest)), none, end))
            .when(full, state(F.concat(s["out"], closed(s["held"])), F.concat(kept, mine), end))
            .otherwise(state(s["out"], F.concat(s["held"], mine), end))
        )

    begin = state(F.array().cast("array<string>"), none, F.lit(0)).cast(_STATE)
    return F.aggregate(F.filter(cut, lambda p: p != ""), begin, step_on, lambda s: F.concat(s["out"], closed(s["held"])))


# Chunks ---------------------------------------------------------------------------------------------------------------------------


def _table_texts(found: Column) -> Column:
    """Texts of at most TABLE_ROWS rows of a table, each with its header; of one without rows its lines as they stand. found: its lines in order, with line and bare."""
    written = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    dashes = lambda cells: F.transform(cells, lambda h: F.repeat(F.lit("-"), F.greatest(F.lit(3), F.length(h))))
    first = _cells(F.get(found, 0)["bare"])
    header = F.when(~_is_rule(first), F.array(written(first), written(dashes(first)))).otherwise(F.array().cast("array<string>"))
    rows = F.transform(F.filter(F.transform(found, lambda x: _cells(x["bare"])), lambda c: ~_is_rule(c)), written)
    rows = T.bound(rows, lambda r: F.when(_is_rule(first), r).otherwise(F.slice(r, 2, F.greatest(F.size(r), F.lit(1)))))
    texts = T.bound(rows, lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / TABLE_ROWS).cast("int")), lambda k: F.array_join(F.concat(header, F.slice(r, k * TABLE_ROWS + 1, TABLE_ROWS)), "\n")))
    return F.when(F.size(rows) > 0, texts).otherwise(F.array(F.array_join(F.transform(found, lambda x: x["line"]), "\n")))


def pieces(pages: DataFrame, key: str, content: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, pos (first line of the block), part, text and type (prose or table) of a page's chunks.

    A header of level 2 or 3 begins a section. Sections don't share chunks, and repeat their header as one of level 3; tables are chunks of their own; a
    chunk of nothing but its header joins the next one. A page without sections and tables is split as a whole."""
    page, whole = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key)
    head = F.col("level").isin(2, 3)
    rows = marked(pages, key, content)
    rows = rows.withColumn("built", F.max(_count(head | (F.col("type") == "table"))).over(whole) == 1)
    rows = rows.withColumn("header", F.last(F.when(head, _title()), ignorenulls=True).over(page))
    tabled = F.col("type") == "table"
    turn = head | (tabled & F.col("starts")) | F.coalesce(~tabled & (F.lag("type").over(page) == "table"), F.lit(False))
    rows = rows.withColumn("block", F.when(F.col("built"), F.sum(_count(turn)).over(page)).otherwise(0)).filter(~F.col("built") | ~head)
    line = F.when(~F.col("built"), F.col("raw")).when(F.col("type") == "blank", "").otherwise(F.col("line"))
    found = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), "bare")))
    blocks = rows.groupBy(key, "block").agg(F.min("pos").alias("pos"), F.bool_or(tabled).alias("tabled"), F.first("built").alias("built"), F.first("header").alias("header"), found.alias("found"))
    title = F.concat(F.lit("### "), F.col("header"))
    text = T.strip(F.array_join(F.transform("found", lambda x: x["line"]), "\n"))
    titled = T.bound(text, lambda t: F.when(t == "", t).when(F.col("header").isNotNull(), F.concat(title, F.lit("\n"), t)).otherwise(t))
    plain = F.when(F.col("built"), titled).otherwise(F.array_join(F.transform("found", lambda x: x["line"]), ""))
    lone = lambda p: F.col("header").isNotNull() & (F.size(p) > 1) & (T.strip(F.get(p, 0)) == T.strip(title))
    merged = lambda p: F.concat(F.array(F.concat(F.get(p, 0), F.lit("\n"), F.get(p, 1))), F.slice(p, 3, F.greatest(F.size(p), F.lit(1))))
    prose = T.bound(split_text(plain, size, overlap), lambda p: F.when(lone(p), merged(p)).otherwise(p))
    tables_ = F.transform(_table_texts(F.col("found")), lambda t: F.when(F.col("header").isNotNull(), F.concat(title, F.lit("\n"), t)).otherwise(t))
    made = blocks.select(key, "pos", F.when(F.col("tabled"), "table").otherwise("prose").alias("type"), F.posexplode(F.when(F.col("tabled"), tables_).otherwise(prose)).alias("part", "text"))
    return made.filter(T.strip(F.col("text")) != "").select(key, "pos", "part", "text", "type")


def chunk_pages(pages: DataFrame, own_host: str, order: str = "page_id") -> DataFrame:
    """The chunks of pages (source_url, dropdown_url, dropdown_title, title, content, an order, and other columns, which are kept): chunk_id,
    content, chunk_index, total_chunks, element_type and content_hash, of the page's text without foreign links and title.

    Of pages of one identity, dropdown_url or else source_url, the first counts; pages without one, or with less than LEAST characters, have
    none. A variant (dropdown_title isn't empty) is one chunk. Chunks are numbered after those shorter than LEAST are left out."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    ident = F.coalesce(some("dropdown_url"), some("source_url"))
    ours = pages.withColumn("_id", ident).filter("_id IS NOT NULL")
    first = ours.groupBy("_id").agg(F.min_by(F.struct(*pages.columns), order).alias("_p")).select("_id", "_p.*").filter(F.length(T.strip(F.coalesce("content", F.lit("")))) >= LEAST)
    clean = first.withColumn("_clean", without_foreign_links(T.strip(F.col("content")), own_host)).withColumn("content_hash", F.sha2("_clean", 256))
    titled = F.concat(F.when(some("title").isNotNull(), F.concat("title", F.lit("\n\n"))).otherwise(""), "_clean")
    clean = clean.withColumn("_text", titled).drop("_clean", "content")
    keep = lambda c: F.length(T.strip(c)) >= LEAST
    whole = clean.filter(some("dropdown_title").isNotNull()).withColumn("content", T.strip(F.col("_text"))).filter(keep(F.col("content")))
    whole = whole.withColumns({"chunk_index": F.lit(0), "total_chunks": F.lit(1), "element_type": F.lit("dropdown_state")}).drop("_text")
    parted = clean.filter(some("dropdown_title").isNull())
    found = pieces(parted, "_id", "_text").filter(keep(F.col("text")))
    at, of = Window.partitionBy("_id").orderBy("pos", "part"), Window.partitionBy("_id")
    found = found.select("_id", T.strip(F.col("text")).alias("content"), (F.row_number().over(at) - 1).alias("chunk_index"), F.count("*").over(of).cast("int").alias("total_chunks"), F.col("type").alias("element_type"))
    parts = parted.drop("_text").join(found, "_id").withColumn("_id", F.col("source_url"))
    both = parts.unionByName(whole).withColumn("chunk_id", T.chunk_id(F.col("_id"), F.col("chunk_index"), F.col("content")))
    return both.drop("_id")


def preflight(pages: DataFrame, chunks: DataFrame, key: str, size: int = SIZE, share: float = 0.05) -> DataFrame:
    """One row: n_pages, n_failed, failure_ratio and ok. A page fails with no chunk of 100 characters or more of content, a chunk of more than
    twice the size, or one without type."""
    worst = chunks.groupBy(key).agg(F.count("*").alias("n"), F.bool_or((F.length("content") > 2 * size) | (F.coalesce("element_type", F.lit("")) == "")).alias("bad"))
    lone = F.col("n").isNull() & (F.length(T.strip(F.coalesce("content", F.lit("")))) >= 100)
    rows = pages.select(key, "content").join(worst, key, "left").select((lone | F.coalesce("bad", F.lit(False))).alias("failed"))
    out = rows.agg(F.count("*").alias("n_pages"), F.count_if("failed").alias("n_failed"))
    ratio = F.coalesce(F.col("n_failed") / F.when(F.col("n_pages") > 0, F.col("n_pages")), F.lit(0.0))
    return out.withColumn("failure_ratio", ratio).withColumn("ok", F.col("failure_ratio") <= share)


KINDS = ("header", "prose", "table", "list", "code")


def page_statistics(pages: DataFrame, key: str, content: str) -> DataFrame:
    """key, how many elements of each type and their characters, n_rows of tables, and the chunks of a flat cut and of one by elements."""
    typed = marked(pages, key, content, typed=True).groupBy(key).agg(
        *[c for k in KINDS for c in (F.count_if(F.col("starts") & (F.col("type") == k)).cast("int").alias(f"n_{k}"), F.coalesce(F.sum(F.when(F.col("type") == k, F.length("line"))), F.lit(0)).cast("int").alias(f"{k}_chars"))]
    )
    by_table = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / TABLE_ROWS).cast("int"))
    found = tables(pages, key, content).groupBy(key).agg(F.sum("n_rows").cast("int").alias("n_rows"), F.sum(by_table).cast("int").alias("_chunks"))
    rows = pages.select(key, F.length(content).alias("_n")).join(typed, key, "left").join(found, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    text = zero("prose_chars") + zero("header_chars")
    return rows.select(
        key, *[zero(c).alias(c) for k in KINDS for c in (f"n_{k}", f"{k}_chars")], zero("n_rows").alias("n_rows"), rough_chunks(F.col("_n")).alias("flat_chunks"),
        (F.when(text > 0, rough_chunks(text)).otherwise(0) + zero("_chunks")).alias("element_chunks"),
    )


def sample_profile(pages: DataFrame, key: str, content: str, n: int, seed: int, oversized: int = 20) -> DataFrame:
    """One row of a seeded sample of n pages that aren't oversized: n_pages (all such), n_sampled, n_with_tables and n_complex (more than 5 rows)."""
    fine = pages.filter(rough_chunks(F.length(content)) < oversized)
    some = fine.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
    rows = some.select(key).join(tables(some, key, content).groupBy(key).agg(F.sum("n_rows").alias("n")), key, "left")
    out = rows.agg(F.count("*").alias("n_sampled"), F.count("n").alias("n_with_tables"), F.count_if(F.col("n") > 5).alias("n_complex"))
    return fine.agg(F.count("*").alias("n_pages")).crossJoin(out)  # one row each


def table_classes(pages: DataFrame, key: str, content: str) -> DataFrame:
    """key, n_tables and kind (NO_TABLE, SPLIT_TABLE or SIMPLE_TABLE) of every page: without a table that has rows there is none, and one that a window tears splits."""
    found = tables(pages, key, content).groupBy(key).agg(F.count("*").cast("int").alias("_n"), F.count_if(F.col("n_rows") > 0).alias("_filled"), F.bool_or("split").alias("_split"))
    kind = F.when(F.coalesce("_filled", F.lit(0)) == 0, "NO_TABLE").when(F.col("_split"), "SPLIT_TABLE").otherwise("SIMPLE_TABLE")
    return pages.select(key).join(found, key, "left").select(key, F.coalesce("_n", F.lit(0)).alias("n_tables"), kind.alias("kind"))
