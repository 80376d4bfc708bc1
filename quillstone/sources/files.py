"""Pages, evaluation sets and reports as files; what is malformed is refused before anything acts on it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, LongType, StringType, StructField, StructType, TimestampType

from ..functions import text as T
from ..functions import urls as U
from .snapshots import Table, current

PAGE = "source_url string, url string, dropdown_url string, dropdown_title string, title string, section string, content string, content_hash string, video_url string, page_purpose string"
FAILURE = "url string, reason string"
#: Names of a page's fields, in the order in which they are tried.
URL_KEYS = ("source_url", "url", "page_url", "link")
CONTENT_KEYS = ("content", "clean_content", "text", "markdown", "body", "page_content", "raw_content")
TITLE_KEYS = ("title", "page_title", "name", "heading")
CATEGORY_KEYS = ("category", "product_category", "section", "topic")
LIST_KEYS = ("pages", "data", "items", "documents", "records", "results")
ANSWER_TYPES = ("single", "multi_required", "multi_any", "unanswerable")


def latest(spark: SparkSession, folder: str, glob: str = "*.json", without: str = "_failures.json") -> str:
    """The path of the file that was changed last, of those that match and don't end in `without`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "modificationTime")  # no content is read
    got = files.filter(~F.col("path").endswith(without)).agg(F.max(F.struct("modificationTime", "path")).alias("f")).first().f
    if got is None:
        raise FileNotFoundError(f"no {glob} in {folder}")
    return got.path


def load_pages(spark: SparkSession, path: str, schema: str = PAGE) -> DataFrame:
    """The page records of a JSON file (an array, or an object a line). Refuses an empty file, and records without source_url or content."""
    pages = spark.read.schema(schema).json(where := current(spark, path), multiLine=where == path)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    n, bad = pages.agg(F.count("*"), F.count_if(blank("source_url") | blank("content"))).first()
    if not n or bad:
        raise ValueError(f"{path}: {n} pages, {bad} of them without source_url or content")
    return pages


def failed_urls(spark: SparkSession, path: str) -> DataFrame:
    """url, without trailing slashes, of a file of failures: what must not be deleted for having vanished."""
    rows = spark.read.schema(FAILURE).json(path, multiLine=True)
    return rows.filter(F.coalesce("url", F.lit("")) != "").select(F.regexp_replace("url", "/+$", "").alias("url")).distinct()


def keyed_pages(pages: DataFrame, order: str) -> DataFrame:
    """The last record of each url and variant."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    url, variant = F.coalesce(some("source_url"), some("url")), F.coalesce(some("dropdown_url"), F.lit(""))
    rows = pages.withColumn("_u", url).withColumn("_v", variant).filter("_u IS NOT NULL")
    return rows.groupBy("_u", "_v").agg(F.max_by(F.struct(*pages.columns), order).alias("r")).select("r.*")


def _pick(record: Column, keys: tuple[str, ...]) -> Column:
    """The first field that isn't empty, by names in any case. record: a map from lower-case names."""
    return F.coalesce(*[F.nullif(F.try_element_at(record, F.lit(k)), F.lit("")) for k in keys])


def records(texts: DataFrame, column: str = "value") -> DataFrame:
    """texts with a row (_pos, record: map of lower-case names to texts) for each record of a JSON text: an array, an object that holds one under a
    known name, an object of objects by url, or a single object."""
    t = F.col(column)
    wrapped = [F.from_json(F.get_json_object(t, f"$.{k}"), "array<map<string,string>>") for k in LIST_KEYS]
    by_url = F.from_json(t, "map<string,map<string,string>>")
    url = lambda e: F.create_map(F.lit("url"), e["key"])
    named = F.transform(F.map_entries(by_url), lambda e: F.when(F.map_contains_key(e["value"], "url"), e["value"]).otherwise(F.map_concat(e["value"], url(e))))
    objects = F.size(F.filter(F.map_values(by_url), lambda v: v.isNotNull())) == F.size(by_url)
    keyed = F.when((F.size(by_url) > 0) & objects, named)
    one = F.array(F.from_json(t, "map<string,string>"))
    found = F.when(F.substring(F.ltrim(t), 1, 1) == "[", F.from_json(t, "array<map<string,string>>")).otherwise(F.coalesce(*wrapped, keyed, one))
    rows = texts.select("*", F.posexplode(found).alias("_pos", "_r")).filter("_r IS NOT NULL")
    return rows.withColumn("record", F.transform_keys("_r", lambda k, _: F.lower(k))).drop("_r")


def tolerant_pages(spark: SparkSession, path: str) -> DataFrame:
    """url, title, category and content (without links) of every file of pages below path, whatever names their fields have; of each url the first, by
    file and place. Without a category the first part of the path is one. Refuses if nothing is usable."""
    from ..operators.markdown import without_links

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.input_file_name().alias("_f"), F.lit(0).cast("long").alias("_l"))
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select("value", F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_l"))
    r = F.col("record")
    url = U.host_lowered(_pick(r, URL_KEYS))
    category = F.coalesce(_pick(r, CATEGORY_KEYS), F.get(U.segments(url), F.lit(0)), F.lit("general"))
    title, content = F.coalesce(_pick(r, TITLE_KEYS), F.lit("")), without_links(_pick(r, CONTENT_KEYS))
    rows = records(files.unionByName(lines).filter(F.trim("value") != ""))
    rows = rows.select("_f", "_l", "_pos", url.alias("url"), title.alias("title"), F.lower(category).alias("category"), content.alias("content"))
    rows = rows.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("content", F.lit("")) != ""))
    first = rows.groupBy("url").agg(F.min_by(F.struct("title", "category", "content"), F.struct("_f", "_l", "_pos")).alias("r")).select("url", "r.*")
    if not first.limit(1).count():
        raise ValueError(f"no usable pages in {path}")
    return first


def load_retrieval_set(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """query_id, query, answer_type, relevant (map of url to grade), answerable, category, variant and provenance of a retrieval set, and the digest of
    its bytes. Refuses rows without id or query, of another type, ids that repeat, and answerable rows without a relevant url or the reverse."""
    raw = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d"), F.decode("content", "UTF-8").alias("value"))
    text = raw.withColumn("value", F.regexp_replace("value", "^\\uFEFF", ""))
    kind = "array<struct<query_id:string,query:string,answer_type:string,relevant_ids:array<string>,answerable:boolean,category:string,variant:string,provenance:string>>"
    rows = text.select(F.explode(F.from_json("value", kind)).alias("r")).select("r.*")
    obj = lambda x, f: F.get_json_object(x, f"$.{f}")
    entry = lambda x: F.struct(U.host_lowered(F.coalesce(obj(x, "url"), x)), F.when(obj(x, "url").isNull(), F.lit(2)).otherwise(F.coalesce(obj(x, "grade").try_cast("int"), F.lit(1))))
    items = F.transform(F.coalesce("relevant_ids", F.array().cast("array<string>")), entry)
    rows = rows.withColumn("query", T.strip(F.coalesce("query", F.lit("")))).withColumn("relevant", F.map_from_entries(items)).drop("relevant_ids")
    rows = rows.withColumn("answerable", F.coalesce("answerable", F.col("answer_type") != "unanswerable"))
    bad = F.col("query_id").isNull() | (F.col("query") == "") | ~F.coalesce(F.col("answer_type").isin(*ANSWER_TYPES), F.lit(False)) | (F.col("answerable") != (F.size("relevant") > 0))
    n, wrong, ids = rows.agg(F.count("*"), F.count_if(bad), F.count_distinct("query_id")).first()
    if not n or wrong or ids != n:
        raise ValueError(f"{path}: {n} rows, {wrong} of them invalid, {ids} different ids")
    return rows, raw.select("d").first().d


def load_answer_set(spark: SparkSession, path: str, unreviewed: bool = False) -> DataFrame:
    """id, question, expected_answer, product_category, source_url and chunk_id of a set of answers, JSON or CSV; rows without an expected answer only
    if unreviewed ones are wanted."""
    kind = "id string, question string, expected_answer string, product_category string, source_url string, chunk_id string"
    if path.lower().endswith(".json"):
        rows = spark.read.schema(kind).json(path, multiLine=True)
    elif path.lower().endswith(".csv"):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
        have = {c.lstrip("﻿").lower(): c for c in rows.columns}
        names = [f.split()[0] for f in kind.split(", ")]
        rows = rows.select(*[F.col(f"`{have[n]}`").alias(n) if n in have else F.lit(None).cast("string").alias(n) for n in names])
    else:
        raise ValueError(f"{path}: neither .json nor .csv")
    rows = rows.withColumn("expected_answer", T.strip(F.coalesce("expected_answer", F.lit(""))))
    rows = rows if unreviewed else rows.filter("expected_answer <> ''")
    return rows.fillna({"product_category": "general", "source_url": "", "chunk_id": ""})


def index_urls(chunks: DataFrame) -> DataFrame:
    """url: the different pages of an index, in the evaluation's form."""
    return chunks.filter(F.coalesce("source_url", F.lit("")) != "").select(U.host_lowered(F.col("source_url")).alias("url")).distinct()


def confirmed(urls: DataFrame, chunks: DataFrame) -> DataFrame:
    """Those of urls (url) that the index has as they are, or with a slash at the end."""
    there = chunks.select(F.col("source_url").alias("_u")).distinct()
    both = urls.select("url", F.explode(F.array("url", F.concat("url", F.lit("/")))).alias("_u"))
    return both.join(there, "_u", "left_semi").select("url").distinct()


def checked_scan(chunks: DataFrame, total: int) -> DataFrame:
    """chunks, if there are as many as the index says."""
    n = chunks.count()
    if n != total:
        raise RuntimeError(f"read {n} of {total} rows")
    return chunks


def fixture_html(spark: SparkSession, urls: DataFrame, folder: str) -> DataFrame:
    """urls (url) with html of the file in folder that is named after the url, and error: fixture_not_found where there is none."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.html").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.html$", 1).alias("_s"), F.col("value").alias("html"))
    out = urls.withColumn("_s", U.slug(F.col("url"))).join(files, "_s", "left")
    return out.withColumn("error", F.when(F.col("html").isNull(), F.concat(F.lit("fixture_not_found:"), "_s"))).drop("_s")


# Sinks ----------------------------------------------------------------------------------------------------------------------------


def save_pages(pages: DataFrame, path: str) -> bool:
    """Writes pages as JSON, as the next version of the table at path: what was there stays until all are written. An empty result leaves it alone.
    Returns whether it wrote."""
    if not pages.limit(1).count():
        return False
    Table(pages.sparkSession, path, "json").write(pages)
    return True


def archive(rows: DataFrame, path: str, run: str) -> None:
    """Keeps the full rows that are to be deleted, by run. A run that comes again writes the same folder again."""
    rows.write.mode("overwrite").json(f"{path}/run={run}")


def save_report(parts: dict[str, DataFrame], path: str) -> None:
    """A table of CSV files for each part of a report, arrays and maps as JSON; an earlier report stays until a part is written."""
    for name, df in parts.items():
        flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, StructType)) or f.dataType.typeName() == "map" else F.col(f.name) for f in df.schema.fields]
        Table(df.sparkSession, f"{path}/{name}", "csv", header=True).write(df.select(*flat))


def save_manifest(spark: SparkSession, manifest: dict, path: str) -> str:
    """One row of JSON; returns the digest of what was written."""
    body = json.dumps(manifest, ensure_ascii=False, sort_keys=True)
    row = spark.range(1).select(F.lit(body).alias("value"))
    row.coalesce(1).write.mode("overwrite").text(path)
    return row.select(F.sha2("value", 256)).first()[0]


def save_evaluation(report: dict, results: DataFrame, path: str) -> str:
    """report.json, its digest and the rows of each query in one folder; returns the digest."""
    digest = save_manifest(results.sparkSession, report, f"{path}/report.json")
    save_manifest(results.sparkSession, {"report.json": digest}, f"{path}/report.sha256")
    save_report({"per_query": results}, path)
    return digest


def save_seed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


# Index tables ---------------------------------------------------------------------------------------------------------------------


def _field(name, kind, *flags):
    return StructField(name, kind, True, {"searchable": "s" in flags, "filterable": "f" in flags, "sortable": "o" in flags, "facetable": "c" in flags, "key": "k" in flags})


#: The fields of an index of chunks; the metadata says what each is for. The vector is searched exactly, by blocks.
INDEX = StructType(
    [
        _field("chunk_id", StringType(), "k", "f"),
        _field("content", StringType(), "s"),
        _field("title", StringType(), "s", "f"),
        *[_field(n, StringType(), "f", "c") for n in ("section", "audience", "content_type", "product_category", "element_type")],
        *[_field(n, StringType(), "f") for n in ("source_url", "dropdown_url", "dropdown_title", "content_hash", "video_url", "collection_name", "page_purpose")],
        _field("description", StringType(), "s"),
        *[_field(n, LongType(), "f", "o") for n in ("chunk_index", "total_chunks", "refresh_count")],
        _field("has_video", BooleanType(), "f", "c"),
        *[_field(n, TimestampType(), "f", "o") for n in ("scraped_at", "indexed_at")],
        _field("embedding", ArrayType(FloatType()), "s"),
    ]
)
#: With questions; WEIGHTS are those of the fields in a lexical score.
QUESTION_INDEX = StructType([*INDEX.fields, _field("title_questions", StringType(), "s"), _field("augmented_questions", StringType(), "s"), _field("parent_url", StringType(), "f")])
WEIGHTS = {"title_questions": 5.0, "title": 4.0, "augmented_questions": 2.0, "section": 2.0, "description": 1.5, "content": 1.0, "dropdown_title": 1.0}


def create_index(spark: SparkSession, path: str, schema: StructType = INDEX, fresh: bool = False) -> Table:
    """The index at path. If there is none, or a fresh one is wanted, an empty version of the schema is committed; earlier ones stay. Refuses one that
    lacks fields of the schema."""
    index = Table(spark, path)
    if fresh or not index.exists():
        index.write(spark.createDataFrame([], schema))
        return index
    lacking = [f.name for f in schema.fields if f.name not in index.read().columns]
    if lacking:
        raise ValueError(f"{path} lacks {lacking}")
    return index
