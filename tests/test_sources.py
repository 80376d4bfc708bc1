import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.sources import files as S
from quillstone.sources import workbook as W
from quillstone.sources.snapshots import Table
from quillstone.storage import materialise, scope, shared_dir

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _xlsx(path, rows):
    """A workbook whose texts are shared or inline, with cells left out where they are None."""
    shared, body = [], []
    for n, row in enumerate(rows, 1):
        cells = []
        for i, v in enumerate(row):
            if v is None:
                continue
            ref = f"{chr(65 + i)}{n}"
            if isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif i % 2:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>')
            else:
                shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
        body.append(f'<row r="{n}">{"".join(cells)}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{NS}"><sheetData>{"".join(body)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{NS}">{"".join(f"<si><t>{s}</t></si>" for s in shared)}</sst>')
    return str(path)


def test_workbook(spark, tmp_path):
    path = _xlsx(tmp_path / "a.xlsx", [["Page URL", " Title ", None, "Active"], ["u1", "t1", None, True], [None, None, None, None], [None, "t3", 5, None]])
    spark.dataSource.register(W.Workbook)
    rows = spark.read.format("workbook").load(path)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, W.workbook_rows(spark, path).collect()))
    got = W.with_headers(rows).orderBy("_row")
    assert got.columns == ["_row", "page_url", "title", "active"] and [tuple(r) for r in got.collect()] == [(2, "u1", "t1", "TRUE"), (4, "", "t3", "")]


def test_approved_pages(spark, tmp_path):
    rows = [["Link", "Name", "HTTP Status", "Category", "Purpose"], ["https://A.com/X/?q", "Title - Brand", 200, " Guidance ", "p"], ["https://A.com/x", "Second", None, None, None], ["https://A.com/dead", "D", 404, None, None], ["https://A.com/gone", "D", "Page removed", None, None], ["mailto:x", "M", None, None, None], ["https://A.com/y", None, "Live", None, None]]
    got = W.approved_pages(W.workbook_rows(spark, _xlsx(tmp_path / "a.xlsx", rows)), (" - Brand",)).orderBy("_row").collect()
    assert [(r.url, r.title, r.category, r.page_purpose) for r in got] == [("https://A.com/x", "Title", "guidance", "p"), ("https://A.com/y", "", "", "")]
    with pytest.raises(ValueError):
        W.approved_pages(W.workbook_rows(spark, _xlsx(tmp_path / "b.xlsx", [["A", "B"], ["x", "y"]])))


def test_url_columns(spark, tmp_path):
    rows = [["Ref", "Web link", "Category", "Other"], ["https://a", "https://b", "c", "x"], ["https://c", "https://d", None, "y"]]
    book = W.workbook_rows(spark, _xlsx(tmp_path / "a.xlsx", rows))
    assert W.url_column(book) == (1, None, 2)
    assert [tuple(r) for r in W.url_rows(book).orderBy("row_num").collect()] == [("https://b", "", "c", 2), ("https://d", "", "", 3)]
    with pytest.raises(ValueError):
        W.url_rows(W.workbook_rows(spark, _xlsx(tmp_path / "b.xlsx", [["A"], ["x"], ["https://a"], ["y"]])))


def _json(path, value):
    path.write_text(json.dumps(value), encoding="utf-8")
    return str(path)


def test_pages(spark, tmp_path):
    good = _json(tmp_path / "a.json", [{"source_url": "u/", "content": "c", "title": "t"}, {"source_url": "v", "content": "d"}])
    assert S.load_pages(spark, good).count() == 2
    for bad in ([], [{"source_url": "u", "content": ""}], [{"url": "u", "reason": "x"}]):
        with pytest.raises(ValueError):
            S.load_pages(spark, _json(tmp_path / "bad.json", bad))
    os.utime(good, (time.time() + 50,) * 2)
    late = _json(tmp_path / "a_failures.json", [{"url": "https://p/1/", "reason": "r"}, {"reason": "x"}])
    os.utime(late, (time.time() + 100,) * 2)
    assert S.latest(spark, str(tmp_path)).endswith("/a.json")
    assert [r.url for r in S.failed_urls(spark, late).collect()] == ["https://p/1"]
    with pytest.raises(FileNotFoundError):
        S.latest(spark, str(tmp_path), "*.csv")
    rows = S.load_pages(spark, good).unionByName(S.load_pages(spark, good).withColumn("content", F.lit("new"))).withColumn("o", F.monotonically_increasing_id())
    assert {r.content for r in S.keyed_pages(rows, "o").collect()} == {"new"}


def test_tolerant_pages(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _json(folder / "1.json", [{"URL": "HTTPS://A.com/Cat/x/", "Content": "![i](u)Text [l](v)", "Title": "T"}, {"url": "https://a.com/no"}])
    _json(folder / "2.json", {"pages": [{"link": "https://a.com/Cat/x", "text": "second"}, {"page_url": "https://b.com/y", "body": "b", "category": "News"}]})
    _json(folder / "3.json", {"https://c.com": {"content": "keyed"}})
    (folder / "4.jsonl").write_text('{"url": "https://d.com/k/l", "markdown": "line"}\n\n', encoding="utf-8")
    got = {r.url: (r.title, r.category, r.content) for r in S.tolerant_pages(spark, str(folder)).collect()}
    assert got == {"https://a.com/Cat/x": ("T", "cat", "Text l"), "https://b.com/y": ("", "news", "b"), "https://c.com": ("", "general", "keyed"), "https://d.com/k/l": ("", "k", "line")}


def test_evaluation_sets(spark, tmp_path):
    row = {"query_id": "1", "query": " q ", "answer_type": "single", "relevant_ids": ["https://A.com/x/", {"url": "https://b.com", "grade": 3}], "category": "c"}
    none = {"query_id": "2", "query": "q", "answer_type": "unanswerable"}
    rows, digest = S.load_retrieval_set(spark, _json(tmp_path / "a.json", [row, none]))
    got = {r.query_id: (r.query, r.relevant, r.answerable) for r in rows.collect()}
    assert got == {"1": ("q", {"https://a.com/x": 2, "https://b.com": 3}, True), "2": ("q", {}, False)} and len(digest) == 64
    for bad in ([row, row], [{**row, "answer_type": "odd"}], [{**row, "query": " "}], [{**row, "relevant_ids": []}], [{**none, "answerable": True}], []):
        with pytest.raises(ValueError):
            S.load_retrieval_set(spark, _json(tmp_path / "b.json", bad))
    answers = [{"id": "1", "question": "q", "expected_answer": " a "}, {"id": "2", "question": "r", "expected_answer": " "}]
    assert [(r.expected_answer, r.product_category) for r in S.load_answer_set(spark, _json(tmp_path / "c.json", answers)).collect()] == [("a", "general")]
    (tmp_path / "d.csv").write_text('id,question,expected_answer\n1,"a, b",x\n2,c,\n', encoding="utf-8")
    assert S.load_answer_set(spark, f"{tmp_path}/d.csv", True).count() == 2 and S.load_answer_set(spark, f"{tmp_path}/d.csv").first().question == "a, b"
    with pytest.raises(ValueError):
        S.load_answer_set(spark, "x.txt")


def test_fixtures(spark, tmp_path):
    (tmp_path / "https_A_com_x_y.html").write_text("<p>page</p>", encoding="utf-8")
    urls = spark.createDataFrame([("https://A.com/X/y/?q",), ("https://A.com/none",)], "url string")
    got = {r.url: (r.html, r.error) for r in S.fixture_html(spark, urls, str(tmp_path)).collect()}
    assert got == {"https://A.com/X/y/?q": ("<p>page</p>", None), "https://A.com/none": (None, "fixture_not_found:https_A_com_none")}


def test_index_scans(spark):
    chunks = spark.createDataFrame([("https://A.com/x/",), ("https://a.com/y",), (None,)], "source_url string")
    assert {r.url for r in S.index_urls(chunks).collect()} == {"https://a.com/x", "https://a.com/y"}
    urls = spark.createDataFrame([("https://A.com/x",), ("https://a.com/z",)], "url string")
    assert [r.url for r in S.confirmed(urls, chunks).collect()] == ["https://A.com/x"]
    assert S.checked_scan(chunks, 3).count() == 3
    with pytest.raises(RuntimeError):
        S.checked_scan(chunks, 4)


def test_sinks(spark, tmp_path):
    pages = spark.createDataFrame([("u", ["a"], 1)], "url string, list array<string>, n int")
    assert S.save_pages(pages, f"{tmp_path}/p") and not S.save_pages(pages.limit(0), f"{tmp_path}/p") and Table(spark, f"{tmp_path}/p").read().count() == 1
    S.archive(pages, f"{tmp_path}/old", "r1"), S.archive(pages, f"{tmp_path}/old", "r2")
    assert spark.read.json(f"{tmp_path}/old").filter("run = 'r2'").count() == 1
    S.save_report({"pages": pages}, f"{tmp_path}/report")
    assert Table(spark, f"{tmp_path}/report/pages").read().first()["list"] == '["a"]'
    digest = S.save_manifest(spark, {"b": 1, "a": 2}, f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m").first()[0] == '{"a": 2, "b": 1}' and len(digest) == 64
    digest = S.save_evaluation({"run_id": "t"}, pages, f"{tmp_path}/run")
    assert len(digest) == 64 and json.loads(spark.read.text(f"{tmp_path}/run/report.json").first()[0]) == {"run_id": "t"}
    assert Table(spark, f"{tmp_path}/run/per_query").read().count() == 1
    S.save_seed(pages.select("url"), f"{tmp_path}/seed")
    index = S.create_index(spark, f"{tmp_path}/ix")
    assert index.read().count() == 0 and S.create_index(spark, f"{tmp_path}/ix").read().columns == S.INDEX.names
    with pytest.raises(ValueError):
        S.create_index(spark, f"{tmp_path}/ix", S.QUESTION_INDEX)
    assert S.create_index(spark, f"{tmp_path}/ix", S.QUESTION_INDEX, fresh=True).read().columns == S.QUESTION_INDEX.names
    assert S.INDEX["chunk_id"].metadata["key"]


def test_storage(spark):
    before = materialise(spark.range(2), "t")
    with scope(spark) as clean:
        one, two = materialise(spark.range(3), "t"), materialise(spark.range(4), "t")
        files = [f.removeprefix("file://") for f in one.inputFiles()]
        assert shared_dir(spark) and one.count() == 3 and all(map(os.path.exists, files))
        assert clean(keep=1) == 1 and not any(map(os.path.exists, files)) and two.count() == 4 and before.count() == 2
