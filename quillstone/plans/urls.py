"""Queries over the urls of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import sync
from .base import read

LANGUAGES = (("/en/", "english"), ("/fr/", "french"), ("/de/", "german"), ("/es/", "spanish"))
HOSTS = ["example.com", "example.org"]


def url_forms(spark, sf_dir):
    """The canonical forms, which differ on purpose."""
    u = F.col("url")
    forms = {
        "canonical": U.canonical_url(u),
        "lowered": U.lowered_url(u),
        "lowered_path": U.url_path(u),
        "compared": U.compared_url(u),
        "bare": U.lowered_without_params(u),
        "host_lowered": U.host_lowered(u),
        "has_fragment": U.has_fragment(u),
        "is_variant": U.is_variant(u, ("#s", "#p")),
        "base": U.base_url(u),
        "segment": U.first_segment(u),
        "host": U.host(u),
        "depth": F.size(U.segments(u)),
    }
    return read(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in forms.items()])


def url_sections(spark, sf_dir):
    u = F.col("url")
    section = U.section(u, {"en": "English", "fr": "French", "de": "German"})
    rules = U.by_first_rule(F.lower(u), LANGUAGES, "general")
    kinds = [section.alias("section"), rules.alias("language"), U.allowed_host(u, HOSTS).alias("allowed"), U.audience(u, ("the", "en")).alias("audience")]
    kinds.append(U.categorised_type(F.lit("Guidance"), u).alias("type"))
    kinds.append(U.is_dedicated(u, ("/en/", "/de/")).alias("dedicated"))
    return read(spark, sf_dir, "pages").select(*kinds).groupBy("section", "language", "allowed", "audience", "type", "dedicated").agg(F.count("*").alias("n_pages"))


def page_dedup(spark, sf_dir):
    """The first page of each canonical url."""
    pages = read(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))
    return sync.first_by(pages, ["canonical"], "page_id")


def page_duplicates(spark, sf_dir):
    """Every page with the one whose host and language it repeats."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    key = F.concat_ws("/", U.host(F.col("url")), U.first_segment(F.col("url")))
    return sync.duplicates_of(pages, key, "page_id", "page_id").select("page_id", "is_duplicate", F.col("duplicate_of").cast("string").alias("duplicate_of"))


def redirects(spark, sf_dir):
    """How urls differ from where they are said to lead, and what becomes of them."""
    u, i = F.col("url"), F.col("page_id") % 5
    parent = F.regexp_replace(U.url_path(u), "/[^/]*$", "")
    final = F.when(i == 0, u).when(i == 1, parent).when(i == 2, F.concat(U.url_path(u), F.lit("-new"))).when(i == 3, F.regexp_replace(u, "/(en|fr|de|es)/", "/new/"))
    final = final.otherwise(F.lit("https://elsewhere.net/x"))
    code = F.when(F.col("page_id") % 11 == 3, 404).when(F.col("page_id") % 13 == 5, 503).otherwise(200)
    rows = read(spark, sf_dir, "pages").select("page_id", "url", final.alias("final"), code.alias("code"))
    return rows.select("page_id", U.redirect_reason(F.col("url"), F.col("final")).alias("reason"), U.health(F.col("code"), F.col("final"), F.col("url"), "example.").alias("status"))


def chunk_estimates(spark, sf_dir):
    n = F.length("text")
    exact, rough = U.estimated_chunks(n), U.rough_chunks(n)
    return read(spark, sf_dir, "documents").select("doc_id", exact.alias("n_chunks"), rough.alias("rough"), U.size_flag(exact, 5, 20).alias("flag"))


QUERIES = {f.__name__: f for f in (url_forms, url_sections, page_dedup, page_duplicates, redirects, chunk_estimates)}

_BARE = "regexp_replace(url, '[?#].*$', '')"
_HEAD = f"regexp_extract({_BARE}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)', 1)"
_CANONICAL = f"regexp_replace({_HEAD} || lower(substr({_BARE}, length({_HEAD}) + 1)), '/+$', '')"
_HOST = r"lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''))"
_SEGMENT = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]*)', 1)"
_PARTS = "list_filter(string_split(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)?$', 1), '/'), lambda s: s <> '')"
_PATH = f"lower({_BARE})"


def _case(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, '{p}') THEN '{v}'" for p, v in rules) + f" ELSE '{default}' END"


_TYPE = _case("lower(url)", U.CONTENT_TYPES, "article")
ORACLE_SQL = {
    "url_forms": f"""
SELECT page_id, {_CANONICAL} AS canonical, lower(regexp_replace(url, '/+$', '')) AS lowered, {_PATH} AS lowered_path,
  regexp_replace({_PATH}, '/+$', '') AS compared, lower(regexp_replace(regexp_replace({_BARE}, ';[^/]*$', ''), '/+$', '')) AS bare,
  regexp_replace(lower({_HEAD}) || substr({_BARE}, length({_HEAD}) + 1), '/+$', '') AS host_lowered,
  contains(url, '#') AS has_fragment, contains(url, '#s') OR contains(url, '#p') AS is_variant, split_part(url, '#', 1) AS base,
  {_SEGMENT} AS segment, {_HOST} AS host, len({_PARTS.format(_BARE)})::INT AS depth FROM pages""",
    "url_sections": f"""
SELECT CASE lower({_SEGMENT}) WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'General' END AS section,
  {_case("lower(url)", LANGUAGES, "general")} AS language,
  regexp_matches(url, '^(?i)https://[^/?#]') AND regexp_matches({_HOST}, '^(?:.*\\.)?(?:example\\.com|example\\.org)$') AS allowed,
  CASE WHEN regexp_matches(lower(url), '(://|^)the\\.|/the/') THEN 'the' WHEN regexp_matches(lower(url), '(://|^)en\\.|/en/') THEN 'en' ELSE 'customer' END AS audience,
  CASE WHEN {_TYPE} IN ('webinar', 'video', 'tool', 'faq', 'news') THEN {_TYPE} ELSE 'guide' END AS type,
  contains(lower(url), '/en/') OR contains(lower(url), '/de/') AS dedicated, count(*) AS n_pages FROM pages GROUP BY ALL""",
    "page_dedup": f"SELECT min(page_id) AS page_id, {_CANONICAL} AS canonical FROM pages GROUP BY 2",
    "page_duplicates": f"""
WITH k AS (SELECT page_id, min(page_id) OVER (PARTITION BY {_HOST} || '/' || {_SEGMENT}) AS f FROM pages)
SELECT page_id, f <> page_id AS is_duplicate, CASE WHEN f <> page_id THEN f::VARCHAR ELSE '' END AS duplicate_of FROM k""",
    "redirects": f"""
WITH r AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace({_PATH}, '/[^/]*$', '') WHEN 2 THEN {_PATH} || '-new'
    WHEN 3 THEN regexp_replace(url, '/(en|fr|de|es)/', '/new/', 'g') ELSE 'https://elsewhere.net/x' END AS final,
    CASE WHEN page_id % 11 = 3 THEN 404 WHEN page_id % 13 = 5 THEN 503 ELSE 200 END AS code FROM pages),
p AS (SELECT *, regexp_replace(regexp_extract(regexp_replace(lower(url), '[?#].*$', ''), '^[a-z][a-z0-9+.-]*://[^/]*(/.*)?$', 1), '/+$', '') AS a,
    regexp_replace(regexp_extract(regexp_replace(lower(final), '[?#].*$', ''), '^[a-z][a-z0-9+.-]*://[^/]*(/.*)?$', 1), '/+$', '') AS b,
    regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS cu, regexp_replace(regexp_replace(lower(final), '[?#].*$', ''), '/+$', '') AS cf FROM r),
s AS (SELECT *, list_filter(string_split(a, '/'), lambda s: s <> '') AS x, list_filter(string_split(b, '/'), lambda s: s <> '') AS y FROM p)
SELECT page_id, CASE WHEN a = b THEN NULL WHEN starts_with(a, b || '/') THEN 'parent'
    WHEN coalesce(x[-1], '') <> '' AND coalesce(y[-1], '') <> '' AND x[-1] <> y[-1] THEN 'slug'
    WHEN len(x) > 0 AND round_even(len(list_filter(y, lambda s: list_contains(x, s))) / len(x) * 100, 0) < 100 THEN 'restructured' ELSE 'other' END AS reason,
  CASE WHEN code = 404 THEN 'dead_404' WHEN code >= 300 THEN 'error' WHEN cu = cf THEN 'live' WHEN contains(final, 'example.') THEN 'internal_redirect'
    ELSE 'external_redirect' END AS status FROM s""",
    "chunk_estimates": """
WITH n AS (SELECT doc_id, length(text) AS n FROM documents),
e AS (SELECT doc_id, CASE WHEN n <= 1600 THEN 1 ELSE greatest(1, floor((n - 200) / 1400)) END::INT AS n_chunks, greatest(1, floor((n - 200) / 1400))::INT AS rough FROM n)
SELECT *, CASE WHEN n_chunks > 20 THEN 'CRITICAL' WHEN n_chunks > 5 THEN 'WARN' ELSE 'OK' END AS flag FROM e""",
}
