"""Queries over an index of chunks: plans, gates, freshness and checks. Two states of the documents stand for an index and a new run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import content, sync
from .base import STRIPPED, read

PAGE = "https://x/{}"


def _chunks(spark, sf_dir, where: str):
    """Documents as chunks: a source is a page, ids divisible by 3 are variants of it."""
    url = F.concat(F.lit("https://x/"), F.coalesce("source", F.lit("none")))
    state = F.when(F.col("doc_id") % 3 == 0, F.concat(url, F.lit("#state="), F.col("doc_id") % 7)).otherwise("")
    docs = read(spark, sf_dir, "documents").filter(where)
    return docs.select(F.col("doc_id").alias("chunk_id"), url.alias("source_url"), state.alias("dropdown_url"), content.content_hash(F.col("text")).alias("content_hash"), F.when(F.col("doc_id") % 9 == 0, "v").otherwise("").alias("video_url"), (F.col("doc_id") % 4).alias("refresh_count"))


def document_changes(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", content.content_hash(F.col("text")).alias("digest"))
    old = docs.filter("doc_id % 10 <> 3")
    new = docs.filter("doc_id % 7 <> 2").withColumn("digest", F.when(F.col("doc_id") % 5 == 0, F.reverse("digest")).otherwise(F.col("digest")))
    return content.changes(old, new, "doc_id", "digest").groupBy("change").agg(F.count("*").alias("n_docs"))


def _plan(spark, sf_dir):
    protected = read(spark, sf_dir, "documents").filter("source = 'src2'").select(F.lit("https://x/src2/").alias("url")).distinct()
    return sync.stale_plan(_chunks(spark, sf_dir, "TRUE"), _chunks(spark, sf_dir, "doc_id % 7 <> 2 AND coalesce(source, '') <> 'src1'"), protected)


def stale_plan(spark, sf_dir):
    """What becomes of every chunk when a seventh of them, and a whole page, are not in a new run, and another page failed."""
    return _plan(spark, sf_dir)


def stale_documents(spark, sf_dir):
    return sync.stale_gate(_plan(spark, sf_dir))


def three_way_sync(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return sync.removal_gate(sync.three_way(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 3 = 0"), "doc_id"))


def current_state(spark, sf_dir):
    return sync.current_state(_chunks(spark, sf_dir, "TRUE"))


def refresh_counts(spark, sf_dir):
    return sync.refresh_counts(_chunks(spark, sf_dir, "TRUE"))


def deletion_counts(spark, sf_dir):
    urls = spark.createDataFrame([("HTTPS://X/src1/",), ("https://x/src2",), ("https://x/nowhere",)], "url string")
    return sync.deletion_counts(_chunks(spark, sf_dir, "TRUE"), urls)


def new_pages(spark, sf_dir):
    pages = _chunks(spark, sf_dir, "TRUE").select("source_url").distinct()
    return sync.new_only(pages, _chunks(spark, sf_dir, "doc_id % 100 < 3"))


def cache_invalidation(spark, sf_dir):
    """Cached answers, here conversations, whose sources hold a changed page."""
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("query")).agg(F.collect_set(F.concat(F.lit("https://x/src"), F.col("turn") + F.col("conv_id") % 9)).alias("source_urls"))
    changed = spark.createDataFrame([("https://X/src3/",), ("https://x/src5",)], "url string")
    return sync.invalidated(turns, changed)


def _freshness(spark, sf_dir):
    pages = _chunks(spark, sf_dir, "TRUE").select(F.col("source_url").alias("url")).distinct()
    n = F.regexp_extract("url", "([0-9]+)$", 1).try_cast("int")
    status = F.when(n == 0, "dead_404").when(n == 1, "internal_redirect").when(n == 2, "external_redirect").when(n == 3, "timeout").otherwise("live")
    state = sync.current_state(_chunks(spark, sf_dir, "coalesce(source, '') <> 'src4'"))
    fresh = sync.current_state(_chunks(spark, sf_dir, "doc_id % 50 <> 1")).select("source_url", F.when(F.col("is_variant"), F.col("identity")).otherwise("").alias("dropdown_url"), "content_hash", "video_url")
    return sync.freshness(pages.filter("url <> 'https://x/src5'"), pages.select("url", status.alias("status")), state, fresh), state


def freshness_actions(spark, sf_dir):
    return _freshness(spark, sf_dir)[0].select("url", "action")


def freshness_breaker(spark, sf_dir):
    return sync.freshness_breaker(*_freshness(spark, sf_dir)).select("n_removed", "n_pages", "tripped")


def snapshot_problems(spark, sf_dir):
    """Problems of the documents as pages against a version of them that is longer, or lacks some."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("u"), F.col("doc_id")).alias("url"), F.lit("").alias("variant"), F.coalesce("lang", F.lit("")).alias("title"), "text", "doc_id")
    new = docs.filter("doc_id % 13 <> 4").select("url", "variant", "title", F.col("text").alias("content"))
    old = docs.filter("doc_id % 11 <> 2").select("url", "variant", F.when(F.col("doc_id") % 5 == 0, F.repeat("text", 2)).otherwise(F.col("text")).alias("content"))
    return sync.page_problems(new, old, frame=("the ", "cookie")).groupBy("severity", "problem").agg(F.count("*").alias("n"))


def failure_gate(spark, sf_dir):
    out = sync.failure_gate(read(spark, sf_dir, "events"), F.col("event_type") == "error")
    return out.withColumn("ratio", F.round("ratio", 6))


def scrape_check(spark, sf_dir):
    rows = _chunks(spark, sf_dir, "TRUE").select(F.coalesce(F.nullif("dropdown_url", F.lit("")), "source_url").alias("url"), F.when(F.col("chunk_id") % 6 == 0, F.col("source_url")).otherwise("").alias("parent_url"), F.when(F.col("dropdown_url") != "", "s").otherwise("").alias("dropdown_state"))
    return sync.scrape_problems(rows)


NAMES = (
    document_changes, stale_plan, stale_documents, three_way_sync, current_state, refresh_counts, deletion_counts, new_pages, cache_invalidation,
    freshness_actions, freshness_breaker, snapshot_problems, failure_gate, scrape_check,
)
QUERIES = {f.__name__: f for f in NAMES}

_C = """c AS (SELECT doc_id AS chunk_id, 'https://x/' || coalesce(source, 'none') AS source_url,
  CASE WHEN doc_id % 3 = 0 THEN 'https://x/' || coalesce(source, 'none') || '#state=' || doc_id % 7 ELSE '' END AS dropdown_url, sha256(coalesce(text, '')) AS content_hash,
  CASE WHEN doc_id % 9 = 0 THEN 'v' ELSE '' END AS video_url, doc_id % 4 AS refresh_count, doc_id, source FROM documents),
i AS (SELECT *, CASE WHEN dropdown_url <> '' THEN dropdown_url ELSE source_url END AS identity FROM c)"""
_PLAN = f"""{_C}, f AS (SELECT * FROM i WHERE doc_id % 7 <> 2 AND coalesce(source, '') <> 'src1'),
p AS (SELECT chunk_id, identity, CASE WHEN chunk_id IN (SELECT chunk_id FROM f) THEN 'keep' WHEN source_url = 'https://x/src2' THEN 'retain' ELSE 'stale' END AS action,
  identity NOT IN (SELECT identity FROM f) AS gone FROM i)"""
_STATE = """SELECT lower(identity) AS identity, min_by(content_hash, chunk_id) AS content_hash, min_by(video_url, chunk_id) AS video_url,
  min_by(dropdown_url <> '', chunk_id) AS is_variant, min_by(source_url, chunk_id) AS source_url FROM i {0} GROUP BY 1"""
_FRESH = f"""{_C}, s AS ({_STATE.format("WHERE coalesce(source, '') <> 'src4'")}), n AS ({_STATE.format("WHERE doc_id % 50 <> 1")}),
g AS (SELECT lower(n.source_url) AS base, bool_or(s.identity IS NULL OR s.content_hash <> n.content_hash OR s.video_url <> n.video_url) AS changed
  FROM n LEFT JOIN s USING (identity) GROUP BY 1),
u AS (SELECT DISTINCT source_url AS url, try_cast(regexp_extract(source_url, '([0-9]+)$', 1) AS INT) AS k FROM c WHERE source_url <> 'https://x/src5'),
a AS (SELECT url, CASE k WHEN 0 THEN 'removed_404' WHEN 1 THEN 'removed_int_redir' WHEN 2 THEN 'removed_ext_redir' WHEN 3 THEN 'scrape_failed' ELSE
    CASE WHEN g.changed IS NULL THEN 'scrape_failed' WHEN lower(url) NOT IN (SELECT identity FROM s WHERE NOT is_variant) THEN 'new' WHEN g.changed THEN 'changed' ELSE 'unchanged' END END AS action
  FROM u LEFT JOIN g ON lower(url) = base
  UNION ALL SELECT identity, 'removed_delisted' FROM s WHERE NOT is_variant AND identity NOT IN (SELECT lower(url) FROM u))"""
_SHORT = f"length({STRIPPED.format('c')}) < 100"
ORACLE_SQL = {
    "document_changes": """
SELECT change, count(*) AS n_docs FROM (SELECT CASE WHEN doc_id % 10 = 3 AND doc_id % 7 = 2 THEN NULL WHEN doc_id % 10 = 3 THEN 'added' WHEN doc_id % 7 = 2 THEN 'deleted'
  WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'same' END AS change FROM documents) WHERE change IS NOT NULL GROUP BY change""",
    "stale_plan": f"WITH {_PLAN} SELECT * FROM p",
    "stale_documents": f"""
WITH {_PLAN}, o AS (SELECT identity, count(*) FILTER (action = 'stale') AS s, count(*) FILTER (action = 'retain') AS r, bool_or(action = 'stale' AND gone) AS g FROM p GROUP BY 1)
SELECT sum(s)::BIGINT AS n_stale, sum(r)::BIGINT AS n_retained, count(*) FILTER (g) AS n_gone, count(*) AS n_identities, n_gone >= 3 AND n_gone > 0.1 * n_identities AS aborted FROM o""",
    "three_way_sync": """
SELECT count(*) FILTER (doc_id % 2 <> 0 AND doc_id % 3 = 0) AS added, count(*) FILTER (doc_id % 6 = 0) AS updated, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) AS deleted,
  deleted >= 3 AND deleted > 0.5 * (updated + deleted) AS refused FROM documents""",
    "current_state": f"WITH {_C} {_STATE.format('')}",
    "refresh_counts": f"WITH {_C} SELECT lower(identity) AS identity, max(refresh_count) AS refresh_count FROM i GROUP BY 1",
    "deletion_counts": f"""
WITH {_C}, w(url, u) AS (VALUES ('HTTPS://X/src1/', 'https://x/src1'), ('https://x/src2', 'https://x/src2'), ('https://x/nowhere', 'https://x/nowhere'))
SELECT url, count(*) AS n_chunks FROM w JOIN c ON lower(source_url) = u GROUP BY 1""",
    "new_pages": f"WITH {_C} SELECT DISTINCT source_url FROM c WHERE source_url NOT IN (SELECT source_url FROM c WHERE chunk_id % 100 < 3)",
    "cache_invalidation": "SELECT DISTINCT conv_id::VARCHAR AS query FROM conversations WHERE turn + conv_id % 9 IN (3, 5)",
    "freshness_actions": f"WITH {_FRESH} SELECT * FROM a",
    "freshness_breaker": f"""
WITH {_FRESH}, m AS (SELECT count(*) FILTER (starts_with(action, 'removed_')) AS n_removed FROM a), t AS (SELECT count(*) AS n_pages FROM s WHERE NOT is_variant)
SELECT n_removed, n_pages, n_removed > greatest(3, floor(n_pages * 0.1)) AS tripped FROM m, t""",
    "snapshot_problems": f"""
WITH d AS (SELECT 'u' || doc_id AS url, doc_id, coalesce(lang, '') AS title, coalesce(text, '') AS c, length(coalesce(text, '')) * CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS old FROM documents),
n AS (SELECT *, {_SHORT} AS short, doc_id % 11 <> 2 AS there, length({STRIPPED.format("CASE WHEN doc_id % 5 = 0 THEN c || c ELSE c END")}) < 100 AS was FROM d WHERE doc_id % 13 <> 4),
p AS (SELECT CASE WHEN there AND was THEN 'WARN' ELSE 'ERROR' END AS severity, 'short' AS problem FROM n WHERE short
  UNION ALL SELECT 'ERROR', 'no heading' FROM n WHERE NOT short AND NOT regexp_matches(c, '(?m)^#\\s+\\S') AND NOT (title <> '' AND contains(lower(c), lower(title)))
  UNION ALL SELECT 'WARN', 'frame' FROM n WHERE NOT short AND (contains(lower(c), 'the ') OR contains(lower(c), 'cookie'))
  UNION ALL SELECT 'ERROR', 'shrunk' FROM n WHERE NOT short AND there AND old > 0 AND (old - length(c)) * 100 / old > 30
  UNION ALL SELECT 'WARN', 'identical' FROM (SELECT 1 FROM n WHERE NOT short GROUP BY trim(regexp_replace(c, '\\s+', ' ', 'g')) HAVING count(DISTINCT url) > 1)
  UNION ALL SELECT 'WARN', 'missing' FROM d WHERE doc_id % 13 = 4 AND doc_id % 11 <> 2)
SELECT severity, problem, count(*) AS n FROM p GROUP BY ALL""",
    "failure_gate": "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, round(n_failed / n, 6) AS ratio, n_failed / n <= 0.05 AS ok FROM events",
    "scrape_check": f"""
WITH {_C}, o AS (SELECT identity AS url, count(*) AS n, count(*) FILTER (chunk_id % 6 <> 0 AND dropdown_url <> '') AS o FROM i GROUP BY 1)
SELECT sum(n)::BIGINT AS n_docs, count(*) FILTER (n > 1) AS n_repeated, sum(o)::BIGINT AS n_orphans, n_docs > 0 AND n_repeated = 0 AND n_orphans = 0 AS ok FROM o""",
}
