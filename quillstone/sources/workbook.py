"""Workbooks (.xlsx) as a Spark data source, read with the standard library: zip and XML.

`spark.read.format("workbook").load(path)` gives a row for each row of the first sheet: _row (its number in the sheet) and cells, an array of
strings, null where a cell is empty. A workbook is one partition; it is read as a stream of rows.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as T
from ..functions import urls as U

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SCHEMA = "_row int, cells array<string>"
#: Headers of the columns, the first that fits counts, and words of a dead status.
URL = ("url", "page url", "link", "webpage", "web page", "web url")
TITLE = ("title", "page title", "name")
STATUS = ("status", "status code", "http status")
CATEGORY = ("category", "content category", "page category", "type")
PURPOSE = ("page purpose", "page_purpose", "purpose")
DEAD = ("dead", "broken", "404", "removed", "gone", "not found")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(raw) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells) of the first sheet of a workbook (a path or a file)."""
    with zipfile.ZipFile(raw) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ET.parse(z.open("xl/sharedStrings.xml")).getroot().iter(f"{_MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
        sheet = sorted(n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n))[0]
        for _, row in ET.iterparse(z.open(sheet)):
            if row.tag != f"{_MAIN}row":
                continue
            cells: list[str | None] = []
            for i, c in enumerate(row.iter(f"{_MAIN}c")):
                at = _column(c.get("r")) if c.get("r") else i
                cells += [None] * (at + 1 - len(cells))
                kind, value = c.get("t"), c.findtext(f"{_MAIN}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "b" and value is not None:
                    value = "TRUE" if value == "1" else "FALSE"
                cells[at] = value
            yield int(row.get("r") or 0), cells
            row.clear()


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        yield from read_sheet(partition.value)


class Workbook(DataSource):
    """For paths that every executor can open; `workbook_rows` reads those that only Spark can."""

    @classmethod
    def name(cls):
        return "workbook"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    """(_row, cells) of the first sheet of a workbook at any path that Spark reads."""
    import io

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = list(read_sheet(io.BytesIO(raw)))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["_row", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def with_headers(rows: DataFrame) -> DataFrame:
    """A column for each header of the first row (lower case, blanks as _), trimmed texts, "" for nothing; blank rows are left out, _row stays."""
    head = rows.orderBy("_row").first()
    names = [re.sub(r"\s+", "_", str(h).strip().lower()) if h is not None else "" for h in (head.cells if head else [])]
    cols = [T.strip(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names) if n]
    out = rows.filter(F.col("_row") > (head["_row"] if head else 0)).select("_row", *cols)
    some = F.lit(False)
    for n in out.columns[1:]:
        some = some | (F.col(f"`{n}`") != "")
    return out.filter(some)


def is_dead(status: Column) -> Column:
    """A code of 400 or more, or a word that says so; all else isn't."""
    s = F.lower(T.strip(F.coalesce(status, F.lit(""))))
    return F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("long") >= 400).otherwise(T.has_any(s, DEAD))


def approved_pages(rows: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """url (canonical), title, category and page_purpose of a sheet of approved pages: of each url the first row that isn't dead. Columns are found by
    their headers; one of urls is needed. suffixes that a title ends in are cut off."""
    head = rows.orderBy("_row").first()
    names = [str(h).strip().lower() if h is not None else "" for h in (head.cells if head else [])]
    at = {k: next((i for i, n in enumerate(names) if n in known), None) for k, known in (("url", URL), ("title", TITLE), ("status", STATUS), ("category", CATEGORY), ("purpose", PURPOSE))}
    if at["url"] is None:
        raise ValueError(f"no column of urls among {names}")
    cell = lambda k: T.strip(F.coalesce(F.get("cells", F.lit(at[k])), F.lit(""))) if at[k] is not None else F.lit("")
    out = rows.filter(F.col("_row") > head["_row"]).select("_row", cell("url").alias("u"), cell("title").alias("title"), cell("status").alias("s"), F.lower(cell("category")).alias("category"), cell("purpose").alias("page_purpose"))
    out = out.filter(F.col("u").startswith("http") & ~is_dead(F.col("s"))).withColumn("url", U.canonical_url(F.col("u")))
    title = F.col("title")
    for s in reversed(suffixes):
        title = F.when(F.col("title").endswith(s), T.strip(F.expr(f"left(title, greatest(0, length(title) - {len(s)}))"))).otherwise(title)
    out = out.withColumn("title", title)
    return out.groupBy("url").agg(F.min_by(F.struct("title", "category", "page_purpose", "_row"), "_row").alias("r")).select("url", "r.title", "r.category", "r.page_purpose", "r._row")


def url_column(rows: DataFrame, sample: int = 10) -> tuple[int | None, int | None, int | None]:
    """The places of the columns of urls, titles and categories. The first is the one of whose first values most begin with http, half at least; of
    equals one whose header says url or link, else the leftmost. The others go by header."""
    head = rows.orderBy("_row").first()
    names = [str(h).strip().lower() if h is not None else "" for h in (head.cells if head else [])]
    cells = rows.filter(F.col("_row") > (head["_row"] if head else 0)).select("_row", F.posexplode("cells").alias("i", "v")).filter("v IS NOT NULL")
    firsts = cells.groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct("_row", "v"))), 1, sample).alias("f"))  # a sheet's rows
    share = F.avg(T.strip(F.col("f.v")).rlike("^https?://").cast("double"))
    scores = dict(firsts.select("i", F.explode("f").alias("f")).groupBy("i").agg(share).collect())
    best = max(scores.values(), default=0.0)
    if best < 0.5:
        return None, None, None
    found = sorted(i for i, s in scores.items() if s == best)
    url = next((i for i in found if i < len(names) and ("url" in names[i] or "link" in names[i])), found[0])
    by = lambda known: next((i for i, n in enumerate(names) if i != url and n in known), None)
    return url, by((*TITLE, "page name")), by(("category", "type", "content type", "page type"))


def url_rows(rows: DataFrame) -> DataFrame:
    """url, title, category and row_num of the rows whose url begins with http, the columns being found by url_column()."""
    url, title, category = url_column(rows)
    if url is None:
        raise ValueError("no column of urls")
    head = rows.agg(F.min("_row")).first()[0]
    cell = lambda i: T.strip(F.coalesce(F.get("cells", F.lit(i)), F.lit(""))) if i is not None else F.lit("")
    out = rows.filter(F.col("_row") > head).select(cell(url).alias("url"), cell(title).alias("title"), cell(category).alias("category"), F.col("_row").alias("row_num"))
    return out.filter(F.col("url").startswith("http"))
