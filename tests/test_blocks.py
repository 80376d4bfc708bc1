"""Elements, tables and chunks against plain programs that read a text line by line, and on cases by hand."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.operators import blocks as B
from quillstone.operators import markdown as M

HOST = "own.org"
DATA = "/root/testdata/sf0.001"
#: What lines may be; texts are made of all runs of four of them, and of these two in longer ones.
KINDS = ["# One", "## Two", "### Three", "plain words", "| a | b |", "|---|---|", "| lone", "", "- item", "  indented", "```", "#tag", "1. first", "##### Five"]


def table(n):
    return "| Fund | Price |\n|---|---|\n" + "\n".join(f"| f{i} | {i}.00p |" for i in range(n))


def plain_elements(text, typed=False):
    """(type, lines) of each element, by one pass with a state."""
    out, state, fenced = [], None, False
    for line in text.removesuffix("\n").split("\n") if text else []:
        bare = line.strip()
        pipe, mark = bare.startswith("|"), re.match(r"#{1,6}\s", bare)
        item, inside = re.match(r"([-*+]|\d+\.)\s", bare), line[:1] in (" ", "\t")
        if typed and mark and len(mark[0]) > 5:
            mark = None
        if typed and (fenced or bare.startswith("```")):
            opens = not fenced
            if bare.startswith("```"):
                fenced = not fenced
            kind, new = "code", opens
        elif typed and bare and (item or (inside and state == "list")):
            kind, new = "list", state != "list"
        elif mark:
            kind, new = "header", True
        elif pipe and (state == "table" or "|" in bare[1:]):
            kind, new = "table", state != "table"
        elif not bare:
            kind, new = "blank", True
        else:
            kind, new = "prose", state != "prose" or pipe or (typed and bare.startswith("#"))
        if new:
            out.append((kind, []))
        out[-1][1].append(line)
        state = kind
    return out


def plain_split(text, size, overlap, separators):
    """The same pieces by plain loops."""
    if not separators:
        return [text]
    sep, pieces, held = separators[0], [], []
    parts = list(text) if not sep else [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    for part in filter(None, parts):
        if len(part) > size:
            pieces += ["".join(held), *plain_split(part, size, overlap, separators[1:])]
            held = []
            continue
        if held and sum(map(len, held)) + len(part) > size:
            pieces.append("".join(held))
            while held and sum(map(len, held)) > min(overlap, size - len(part)):
                del held[0]
        held.append(part)
    return [p.strip() for p in [*pieces, "".join(held)] if p.strip()]


def texts_of_kinds():
    out = []
    for i in range(len(KINDS) ** 3):
        a, b, c = i % len(KINDS), i // len(KINDS) % len(KINDS), i // len(KINDS) ** 2
        out.append("\n".join(KINDS[k] for k in (a, b, c, (a + b) % len(KINDS), (b * c + 3) % len(KINDS))))
    return [*out, "", "one"]


@pytest.mark.parametrize("typed", [False, True])
def test_elements_equal_a_pass_with_a_state(spark, typed):
    texts = texts_of_kinds()
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in B.elements(df, "k", "t", typed).orderBy("k", "element").collect():
        got.setdefault(r.k, []).append((r.type, r.n_lines, r.n_chars, r.first))
    for k, text in enumerate(texts):
        at, want = 0, []
        for kind, found in plain_elements(text, typed):
            want.append((kind, len(found), sum(map(len, found)), at))
            at += len(found)
        assert got.get(k, []) == want, text


def test_split_equals_plain_loops(spark):
    words = " ".join(f"w{i}" * (i % 5 + 1) for i in range(60))
    texts = [None, "", "short", "x" * 1000, words, words.replace(" ", ". "), f"{words}\n\n{words}\n{'y' * 95}\n\n\n", "a\n\n" * 40, f"{'z' * 130} b. c", " \n\n ", "One sentence here. " * 30]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size, overlap in ((100, 20), (100, 0), (37, 36), (10, 3), (60, 80)):
        got = [r[0] for r in df.select(B.split_text(F.coalesce("t", F.lit("")), size, overlap)).collect()]
        for t, g in zip(texts, got, strict=True):
            assert g == plain_split(t or "", size, overlap, M.SEPARATORS), (size, overlap, t)


def pieces(spark, text):
    rows = B.pieces(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("pos", "part").collect()
    return [(r.text, r.type) for r in rows]


def test_tables(spark):
    for n in (5, 30):
        out = pieces(spark, table(n))
        assert [k for _, k in out] == ["table"] and out[0][0].count("\n") == n + 1
    out = pieces(spark, table(35))
    assert [k for _, k in out] == ["table", "table"] and all(t.startswith("| Fund | Price |\n| ---- | ----- |") for t, _ in out)
    assert [t.count("f") for t, _ in out] == [30, 5]
    assert pieces(spark, "| a | b |\n|---|---|") == [("| a | b |\n|---|---|", "table")]
    assert pieces(spark, "|---|---|\n| 1 | 2 |") == [("| 1 | 2 |", "table")]
    assert [t for t, _ in pieces(spark, "## Head\nintro\n| a | b |\n| 1 | 2 |\nafter")] == ["### Head\nintro", "### Head\n| a | b |\n| --- | --- |\n| 1 | 2 |", "### Head\nafter"]


def test_sections_begin_at_levels_two_and_three(spark):
    out = pieces(spark, "## Alpha\nFirst text.\n\n### Beta\nSecond text.\n#### Deep\nMore.")
    assert [t for t, _ in out] == ["### Alpha\nFirst text.", "### Beta\nSecond text.\n#### Deep\nMore."]
    assert [t for t, _ in pieces(spark, "# Top\nIntro.\n## A\nText.")] == ["# Top\nIntro.", "### A\nText."]
    assert pieces(spark, "") == [] and pieces(spark, "  \n\n ") == [] and pieces(spark, None) == []


def test_a_header_alone_joins_the_next_piece(spark):
    long = "word " * 400
    out = pieces(spark, f"## Head\n{long}\n\n{long}")
    assert len(out) > 1 and out[0][0].startswith("### Head\nword")


def test_pieces_of_whole_texts(spark):
    """Without sections and tables a text is split as a whole: all of sf0.001 against the plain loops."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {}
    for r in B.pieces(docs, "doc_id", "text").orderBy("doc_id", "pos", "part").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall():
        kinds = plain_elements(t or "")
        if not any(k == "table" or k == "header" and re.match(r"#{2,3}\s", x[0].strip()) for k, x in kinds):
            assert got.get(i, []) == plain_split(t or "", M.SIZE, M.OVERLAP, M.SEPARATORS)


def test_chunk_pages(spark):
    long = "Some sentence that is long enough to be kept as a chunk of its own page. " * 30
    rows = [
        (1, "https://p/a", "", "", "Title", f"## One\n{long}\n## Two\ntiny"),
        (2, "https://p/a", "", "", "Again", long),
        (3, "https://p/a", "https://p/a#state=x", "X", None, "The state of a page, which is one chunk however long it is."),
        (4, "https://p/b", "", "", None, "short"),
        (5, None, None, "", "No url", long),
    ]
    pages = spark.createDataFrame(rows, "page_id int, source_url string, dropdown_url string, dropdown_title string, title string, content string")
    got = B.chunk_pages(pages, HOST).orderBy("page_id", "chunk_index").collect()
    assert {r.page_id for r in got} == {1, 3} and [r.element_type for r in got if r.page_id == 3] == ["dropdown_state"]
    mine = [r for r in got if r.page_id == 1]
    assert [r.chunk_index for r in mine] == list(range(len(mine))) and {r.total_chunks for r in mine} == {len(mine)}
    assert all(len(r.content) >= 50 for r in got) and len({r.content_hash for r in mine}) == 1
    check = B.preflight(pages.filter("page_id IN (1, 4)"), B.chunk_pages(pages, HOST), "page_id").first()
    assert tuple(check) == (2, 0, 0.0, True)


def test_tables_and_windows(spark):
    content = "x" * 1500 + "\r\n" + table(20) + "\n" + "y" * 10
    df = spark.createDataFrame([(1, content), (2, "none"), (3, None), (4, "| a | b |\n|---|---|")], "k int, t string")
    assert {r.k: (r.kind, r.n_tables) for r in B.table_classes(df, "k", "t").collect()} == {1: ("SPLIT_TABLE", 1), 2: ("NO_TABLE", 0), 3: ("NO_TABLE", 0), 4: ("NO_TABLE", 1)}
    t = B.tables(df, "k", "t").filter("k = 1").first()
    assert (t.n_rows, t.n_columns, t.start, t.end, t.split) == (20, 2, 1502, 1502 + len(table(20)) + 1, True)
    for start in range(0, 3200, 7):  # the end of a window falls inside, told window by window
        end = start + 40
        want = any(start < min(s + 1600, 5000) < end for s in range(0, 5000, 1400))
        k = max(0, (start - 1600) // 1400 + 1) * 1400 + 1600
        assert (k < end) == want
    df = df.filter("k < 3").select(F.coalesce("t", F.lit("")).alias("t"))
    torn = df.limit(1).select(F.filter(M.priced_rows(F.col("t")), lambda r: r["start_chunk"] != r["end_chunk"])).first()[0]
    rows = df.limit(1).select(F.size(M.priced_rows(F.col("t")))).first()[0]
    lines, at, want = content.splitlines(keepends=True), 0, 0
    for line in lines:
        want += ".00p" in line and at < 1600 <= at + len(line) - 1
        at += len(line)
    assert rows == 20 and len(torn) == want
    left = spark.createDataFrame([("<table><tr>\n" + "a    b    c    and a long tail of text here\n" * 5,)], "t string").select(M.html_tags_left(F.col("t")), M.aligned_lines(F.col("t"))).first()
    assert tuple(left) == (2, 5)


def test_statistics(spark):
    text = "# A\n- one\n  more\n- two\nprose\n```\n# code\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n\n1. x"
    pages = spark.createDataFrame([(1, text), (2, table(35)), (3, "x" * 50_000), (4, None)], "k int, t string")
    got = {r.k: r for r in B.page_statistics(pages, "k", "t").collect()}
    assert (got[1].n_table, got[1].n_rows, got[1].n_list, got[2].n_rows, got[2].element_chunks, got[3].flat_chunks, got[4].n_prose) == (1, 1, 2, 35, 2, 35, 0)
    assert tuple(B.sample_profile(pages, "k", "t", 5, 1).first()) == (3, 3, 2, 1)
