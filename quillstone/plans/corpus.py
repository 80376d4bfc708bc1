"""Queries over texts: forms, ids, duplicates, cleaning, chunks, questions and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks, content, markdown, markup, questions, review, sync, versions
from .base import COLLAPSED, STRIPPED, TOKENS, question, read, same_question

OWN = "example.com"


def _lines(spark, sf_dir):
    """The lines of documents as questions of chunks: a document is a chunk, its source a page."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("page"), F.coalesce("lang", F.lit("none")).alias("lang"), "text")
    return questions.listed(docs, "text").select("doc_id", "page", "lang", "pos", "question")


def text_forms(spark, sf_dir):
    t = F.col("text")
    forms = {"norm": T.norm_text(t), "question": T.norm_question(t), "same": T.same_question(t), "bare": T.bare_question(t), "sanitized": T.sanitized(t), "unlinked": markdown.without_links(t)}
    n = F.size(T.alnum_words(t))
    cols = [F.md5(c).alias(f"{name}_md5") for name, c in forms.items()]
    return read(spark, sf_dir, "documents").select("doc_id", *cols, n.alias("n_tokens"), T.n_words(F.coalesce(t, F.lit(""))).alias("n_words"), T.size_bucket(n).alias("bucket"))


def content_ids(spark, sf_dir):
    t = F.col("text")
    ids = [content.content_hash(t).alias("digest"), T.chunk_id(T.first_filled(F.col("source"), F.lit("none")), F.col("doc_id"), t).alias("chunk_id"), T.question_id(t).alias("question_id")]
    return read(spark, sf_dir, "documents").select("doc_id", *ids)


def citation_lists(spark, sf_dir):
    """Marks of citations, and their renumbering against three sources, two of them of one page."""
    marked = F.concat_ws(" ", F.lit("[3] [1]"), F.col("text"), F.lit("[2] [3] [99]"))
    made = T.citations_renumbered(marked, F.array(*[F.lit(u) for u in ("a", "b", "a")]))
    listed = F.array_join(F.transform(T.citations(marked, 9), lambda n: n.cast("string")), ",")
    return read(spark, sf_dir, "documents").select("doc_id", listed.alias("cited"), F.md5(T.without_citations(F.col("text"))).alias("bare_md5"), F.md5(made["text"]).alias("shown_md5"), F.size(made["cited"]).alias("n_cited"))


def duplicate_documents(spark, sf_dir):
    return review.duplicate_groups(read(spark, sf_dir, "documents"), content.content_hash(F.col("text")), "doc_id")


def duplicate_survivors(spark, sf_dir):
    """Of equal texts the one that is oldest, here by source, then id, survives."""
    return sync.survivors(read(spark, sf_dir, "documents"), content.content_hash(F.col("text")), "source", "doc_id")


def repetition_gate(spark, sf_dir):
    out = sync.repetition(read(spark, sf_dir, "documents"), content.content_hash(F.col("text")), 0.05)
    return out.withColumn("share", F.round("share", 6))


def document_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return content.chunks(docs).select("doc_id", "chunk_index", "total_chunks", F.md5("chunk").alias("chunk_md5"))


def cleaning(spark, sf_dir):
    """What is left of a text after cleaning, and what each rule takes."""
    losses = markdown.cleaning_losses(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(markdown.cleaned(F.col("text"))).alias("cleaned_md5"), *losses[1:])


def md_elements(spark, sf_dir):
    """How many elements of each type a text has, and their characters."""
    rows = blocks.elements(read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


def md_tables(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    looks = docs.select("doc_id", markdown.html_tags_left(F.col("text")).alias("n_tags"), markdown.aligned_lines(F.col("text")).alias("n_aligned"))
    return blocks.table_classes(docs, "doc_id", "text").join(looks, "doc_id")


def md_statistics(spark, sf_dir):
    return blocks.page_statistics(read(spark, sf_dir, "documents"), "doc_id", "text")


def md_profile(spark, sf_dir):
    return blocks.sample_profile(read(spark, sf_dir, "documents"), "doc_id", "text", 30, 42, 5)


def document_pieces(spark, sf_dir):
    """The chunks of every text by its sections and tables."""
    return blocks.pieces(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pos", "part", "type", F.md5("text").alias("text_md5"))


def page_chunks(spark, sf_dir):
    """Pages to chunks: content, cleaning, splitting, ids."""
    rows = markup.page_rows(read(spark, sf_dir, "pages")).filter("problem IS NULL")
    pages = rows.select("page_id", F.col("url").alias("source_url"), F.lit("").alias("dropdown_url"), F.lit("").alias("dropdown_title"), F.lit("Page").alias("title"), "content")
    return blocks.chunk_pages(pages, OWN).select("page_id", "chunk_index", "total_chunks", "element_type", "chunk_id", "content_hash")


def main_content(spark, sf_dir):
    rows = markup.page_rows(read(spark, sf_dir, "pages"))
    return rows.select("page_id", "problem", "content_hash", "read_time_mins", "has_video", "n_visible", "has_dropdown", F.size("tabs").alias("n_tabs"), "description", "image")


def document_versions(spark, sf_dir):
    """What an edit changes in every text: cleaned, with a word written otherwise and one line in seven gone."""
    old = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.filter(F.split(F.regexp_replace(markdown.cleaned(F.col("text")), r"\bthe\b", "this"), "\n"), lambda x, i: i % 7 != 3)
    made = versions.compared(old, old.withColumn("text", F.array_join(lines, "\n")), "doc_id", "text")
    return made.select("doc_id", "old_lines", "new_lines", "same", "similarity", "added", "removed", F.md5(F.array_join("words", "\n")).alias("words_md5"))


def page_facts(spark, sf_dir):
    h = F.coalesce(F.col("html"), F.lit(""))
    n = lambda tag: F.regexp_count(h, F.lit(f"(?i)<{tag}[ >/]"))
    marks = F.array_join(markup.markers(h, ("<nav", "charset=", "id=.app", "<table")), ",")
    cols = [n(t).alias(f"n_{t}") for t in ("img", "a", "iframe", "table", "select", "li")]
    return read(spark, sf_dir, "pages").select("page_id", T.page_title(h).alias("title"), *cols, marks.alias("markers"))


def question_collisions(spark, sf_dir):
    """Lines that two documents or more have, graded, with the sources they come from."""
    return questions.collisions(_lines(spark, sf_dir), "doc_id", "page")


def collision_severity(spark, sf_dir):
    found = question_collisions(spark, sf_dir)
    return found.groupBy("severity").agg(F.count("*").alias("n_questions"), F.sum("n").alias("n_chunks"))


def collision_summary(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return questions.collision_summary(lines, questions.collisions(lines, "doc_id", "page"), "doc_id")


def collision_impact(spark, sf_dir):
    return questions.collision_impact(question_collisions(spark, sf_dir))


def dangerous_questions(spark, sf_dir):
    return questions.dangerous(question_collisions(spark, sf_dir)).select("question", "n", "n_urls", "severity")


def collisions_by_language(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return questions.collisions_by(lines, questions.collisions(lines, "doc_id", "page"), "lang")


def priority_dedup(spark, sf_dir):
    """Lines that stand in more than three places, left in the chunk of the best priority only."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("https://x/"), F.coalesce("lang", F.lit("none")), F.lit("/isa/")).alias("source_url"), (F.col("doc_id") % 5).alias("chunk_index"), F.col("text").alias("augmented_questions"), F.lit("").alias("title_questions"))
    out = questions.dedup_questions(docs, generic=("/en/",))
    return out.select("chunk_id", F.md5(F.coalesce("augmented_questions", F.lit(""))).alias("questions_md5"))


def seed_questions(spark, sf_dir):
    """The first occurrence of every question, at most 20 of a source."""
    docs = read(spark, sf_dir, "documents")
    chunks = docs.select(F.coalesce("lang", F.lit("general")).alias("product_category"), F.coalesce("source", F.lit("")).alias("source_url"), F.lit("").alias("parent_url"), F.col("doc_id").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.col("doc_id").alias("pos_in_index"), F.lit("").alias("title_questions"), F.col("text").alias("augmented_questions"))
    return questions.seed_rows(chunks, 20).select("source_url", "chunk_id", "product_category", F.md5("question").alias("question_md5"))


def question_quality(spark, sf_dir):
    """The first line of every document, judged as a question about it."""
    first = F.substring_index(F.col("text"), "\n", 1)
    rows = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", first.alias("q"), F.col("text").alias("t"))
    return rows.select("doc_id", questions.question_score(F.col("q"), F.col("t"), terms=("er", "qu")).alias("score"), questions.is_title_question(F.col("q"), F.col("t")).alias("is_title"), questions.is_valid_generated(F.col("q")).alias("is_valid"), questions.is_evidence(F.col("q"), F.col("t")).alias("is_evidence"))


def category_sample(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"))
    return questions.round_robin(docs, "source", "doc_id", 60, 5)


def stratified_sample(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"))
    return questions.stratified(docs, "source", "doc_id", 60, 7, docs.filter("doc_id % 2 = 0"))


def low_signal(spark, sf_dir):
    rows = questions.with_signal(read(spark, sf_dir, "conversations"), "text")
    return questions.by_category(rows, "role", exclude=("system",)).groupBy("role").agg(F.count("*").alias("n_turns"))


def fuzzy_items(spark, sf_dir):
    """Benchmark items that are not like an earlier one of their category."""
    items = read(spark, sf_dir, "benchmark").withColumn("category", (F.col("item_id") % 4).cast("string"))
    return questions.fuzzy_dedup(items, "category", "text", "item_id").select("item_id", "category")


def top_terms(spark, sf_dir):
    found = questions.top_terms(read(spark, sf_dir, "documents"), "doc_id", "text", 30)
    return found.select("doc_id", F.array_join("terms", ",").alias("terms"))


def topic_pairs(spark, sf_dir):
    """The pairs of benchmark items of a category that share most of their terms."""
    items = read(spark, sf_dir, "benchmark").withColumn("category", F.col("item_id") % 3)
    rows = items.select("item_id", "category").join(questions.top_terms(items, "item_id", "text"), "item_id")
    return questions.topic_pairs(rows, "item_id", "category", "terms", 20, 0.02).select("a", "b", F.round("likeness", 6).alias("likeness"))


def product_pages(spark, sf_dir):
    """Documents that speak of given terms, with their score."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("https://x/a/"), F.coalesce("source", F.lit("none"))).alias("url"), F.coalesce("lang", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("content"))
    return questions.eligible(docs, ("en", "the", "src1"), 3).select("doc_id", "score")


def representative_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("lang", F.lit("none")).alias("content_type"), F.col("text").alias("content"), (F.col("doc_id") % 4).alias("chunk_index"), F.lit(4).alias("total_chunks"), F.lit("q").alias("augmented_questions"))
    return questions.representative(questions.classified(docs), 30, {"de": 0.4, "fr": 0.3, "en": 0.3}).select("chunk_id", "content_type", "size_category", "position")


NAMES = (
    text_forms, content_ids, citation_lists, duplicate_documents, duplicate_survivors, repetition_gate, document_chunks, cleaning, md_elements, md_tables, md_statistics, md_profile, document_pieces,
    page_chunks, main_content, document_versions, page_facts, question_collisions, collision_severity, collision_summary, collision_impact, dangerous_questions,
    collisions_by_language, priority_dedup, seed_questions, question_quality, category_sample, stratified_sample, low_signal, fuzzy_items, top_terms,
    topic_pairs, product_pages, representative_chunks,
)
QUERIES = {f.__name__: f for f in NAMES}

_T = TOKENS.format("text")
_WORDS = f"len(list_filter(string_split({COLLAPSED.format('coalesce(text, $$$$)')}, ' '), lambda w: w <> ''))::INT"
_SEVERITY = "CASE WHEN n >= 21 THEN 'critical' WHEN n >= 11 THEN 'high' WHEN n >= 4 THEN 'medium' ELSE 'low' END"
_LISTED = f"""l AS (SELECT doc_id, coalesce(source, 'none') AS page, coalesce(lang, 'none') AS lang, line, pos - 1 AS pos
  FROM (SELECT doc_id, source, lang, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT *,
    list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {STRIPPED.format('x')}), lambda x: x <> '') AS lines FROM documents))),
q AS (SELECT *, {question('line')} AS question FROM l)"""
_COLLISIONS = f"""{_LISTED},
k AS (SELECT question, count(DISTINCT doc_id) AS n, count(DISTINCT page) AS n_urls FROM q GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT question, n, n_urls, {_SEVERITY} AS severity, n_urls > 1 AS cross_page, CASE WHEN n_urls > 1 AND n >= 21 THEN least(n, 5) ELSE 0 END::BIGINT AS slots FROM k)"""
_COUNT = "len(regexp_extract_all(coalesce(html, ''), '(?i)<{0}[ >/]'))::INT AS n_{0}"


def _cleaned() -> str:
    """The SQL of the cleaning rules, a step each; no text here has a second copy behind a heading."""
    steps, n = ["s0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"], 0
    for name, pattern, _ in markdown.NOISE:
        steps.append(f"s{n + 1} AS (SELECT *, regexp_replace(t{n or ''}, '{pattern}', '', 'g') AS t{n + 1}, (length(t{n or ''}) - length(t{n + 1}))::INT AS {name} FROM s{n})")
        n += 1
    last = f"t{n}"
    for pattern, new in ((r"\n{3,}", r"\n\n"), (r"[ \t]+\n", r"\n"), (r"\n[ \t]+\n", r"\n\n")):
        last = f"regexp_replace({last}, '{pattern}', E'{new}', 'g')"
    names = ", ".join(name for name, _, _ in markdown.NOISE)
    return f"WITH {', '.join(steps)} SELECT doc_id, md5({STRIPPED.format(last)}) AS cleaned_md5, {names} FROM s{n}"


def _marked(typed: bool) -> str:
    """The SQL of lines with the types of their elements, as table m."""
    ends = r"\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}"
    page, run = "OVER (PARTITION BY doc_id ORDER BY pos)", "OVER (PARTITION BY doc_id, run{0} ORDER BY pos)"
    code = "starts_with(bare, '```') OR odd" if typed else "false"
    listed = f"goes AND max((goes AND item)::INT) {run.format(1)} = 1" if typed else "false"
    header = "{1,4}" if typed else "{1,6}"
    breaks = "starts_with(bare, '|') OR starts_with(bare, '#')" if typed else "starts_with(bare, '|')"
    return rf"""
l AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) AS pos FROM (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{ends}]*(?:\r\n|[{ends}])|[^{ends}]+') AS x FROM documents)),
b AS (SELECT *, regexp_replace(raw, '(\r\n|[{ends}])$', '') AS line, {STRIPPED.format('raw')} AS bare, length(raw) AS len FROM l),
c AS (SELECT *, sum(len) {page} - len AS place, sum(starts_with(bare, '```')::INT) {page} % 2 = 1 AS odd, regexp_matches(bare, '^([-*+]|[0-9]+\.)\s') AS item FROM b),
g AS (SELECT *, {code} AS code, (starts_with(bare, '```') AND odd AND {typed}) AS opens,
  NOT ({code}) AND bare <> '' AND (item OR regexp_matches(line, '^\s')) AS goes FROM c),
h AS (SELECT *, sum((NOT goes)::INT) {page} AS run1 FROM g),
i AS (SELECT *, {listed} AS listed FROM h),
j AS (SELECT *, starts_with(bare, '|') AND NOT code AND NOT listed AS piped,
  CASE WHEN code OR listed THEN 0 ELSE length(regexp_extract(bare, '^(#{header})\s', 1)) END AS level FROM i),
k AS (SELECT *, sum((NOT piped)::INT) {page} AS run2 FROM j),
o AS (SELECT *, CASE WHEN code THEN 'code' WHEN listed THEN 'list' WHEN level > 0 THEN 'header'
  WHEN piped AND max((piped AND contains(substr(bare, 2), '|'))::INT) {run.format(2)} = 1 THEN 'table' WHEN bare = '' THEN 'blank' ELSE 'prose' END AS type FROM k),
m AS (SELECT *, type IN ('header', 'blank') OR opens OR (type = 'prose' AND ({breaks})) OR lag(type, 1, '') {page} <> type AS starts FROM o)"""


_RULE = "len(list_filter(cells, lambda x: x <> '' AND NOT regexp_matches(x, '^[-:]+$'))) = 0"
_TABLES = rf"""
t AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS element FROM m),
u AS (SELECT *, list_transform(string_split(regexp_replace(bare, '^\|+|\|+$', '', 'g'), '|'), lambda x: {STRIPPED.format('x')}) AS cells FROM t WHERE type = 'table'),
v AS (SELECT doc_id, min(place) AS start, max(place + len) AS e, count(*) FILTER (NOT ({_RULE})) - (CASE WHEN arg_min({_RULE}, pos) THEN 0 ELSE 1 END) AS n_rows FROM u GROUP BY doc_id, element),
w AS (SELECT doc_id, count(*)::INT AS n_tables, sum(n_rows)::INT AS n_rows, count(*) FILTER (n_rows > 0) AS filled, sum(greatest(1, ceil(n_rows / 30)))::INT AS chunks,
  bool_or(greatest(0, floor((start - 1600) / 1400) + 1) * 1400 + 1600 < e) AS split FROM v GROUP BY doc_id)"""
_ROUGH = "greatest(1, floor(({0} - 200) / 1400))::INT"


ORACLE_SQL = {
    "text_forms": rf"""
SELECT doc_id, md5(array_to_string({_T}, ' ')) AS norm_md5, md5({question('text')}) AS question_md5, md5({same_question('text')}) AS same_md5,
  md5({STRIPPED.format("regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', '', 'g')")}) AS bare_md5,
  md5({COLLAPSED.format(r"regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')")}) AS sanitized_md5,
  md5({STRIPPED.format(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g')")}) AS unlinked_md5,
  len({_T})::INT AS n_tokens, {_WORDS} AS n_words, CASE WHEN len({_T}) < 300 THEN 'short' WHEN len({_T}) > 700 THEN 'long' ELSE 'medium' END AS bucket FROM documents""",
    "content_ids": f"""
SELECT doc_id, sha256(coalesce(text, '')) AS digest, sha256(coalesce(nullif(trim(source), ''), 'none') || '|' || doc_id || '|' || coalesce(text, '')) AS chunk_id,
  'q-' || left(sha1({same_question('text')}), 10) AS question_id FROM documents""",
    "citation_lists": rf"""
WITH m AS (SELECT doc_id, text, [x::INT FOR x IN regexp_extract_all(concat_ws(' ', '[3] [1]', text, '[2] [3] [99]'), '\[([0-9]{{1,6}})\]', 1)] AS n FROM documents)
SELECT doc_id, array_to_string([x FOR x, i IN n IF list_position(n, x) = i AND x BETWEEN 1 AND 9], ',') AS cited,
  md5({STRIPPED.format(r"regexp_replace(regexp_replace(coalesce(text, ''), '\[[0-9]+\]', '', 'g'), '[\s\x0b]{2,}', ' ', 'g')")}) AS bare_md5,
  md5(regexp_replace('[1]  ' || concat_ws(' ', text, '[2] [1] '), ' {{2,}}', ' ', 'g')) AS shown_md5, 2 AS n_cited FROM m""",
    "duplicate_documents": "SELECT sha256(coalesce(text, '')) AS key, count(*) AS n, min(doc_id) AS survivor FROM documents GROUP BY 1 HAVING count(*) > 1",
    "duplicate_survivors": """
WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS d, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY coalesce(source, ''), doc_id) AS r,
  count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS n FROM documents)
SELECT a.doc_id, b.doc_id AS survivor, a.r > 1 AS is_victim FROM h a JOIN h b USING (d) WHERE a.n > 1 AND b.r = 1""",
    "repetition_gate": """
WITH g AS (SELECT count(*) AS n FROM documents GROUP BY sha256(coalesce(text, '')))
SELECT sum(n)::BIGINT AS n_rows, count(*) FILTER (n > 1) AS n_groups, coalesce(sum(n - 1) FILTER (n > 1), 0)::BIGINT AS n_removable,
  round(n_removable / n_rows, 6) AS share, n_removable / n_rows <= 0.05 AS ok FROM g""",
    "document_chunks": r"""
WITH d AS (SELECT doc_id, [w FOR w IN regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+') IF w <> ''] AS w FROM documents),
n AS (SELECT *, greatest(1, ceil((len(w) - 40) / 160))::INT AS total_chunks FROM d WHERE len(w) > 0),
c AS (SELECT *, unnest(range(total_chunks))::INT AS chunk_index FROM n)
SELECT doc_id, chunk_index, total_chunks, md5(array_to_string(w[chunk_index * 160 + 1 : chunk_index * 160 + 200], ' ')) AS chunk_md5 FROM c""",
    "cleaning": _cleaned(),
    "md_elements": f"WITH {_marked(False)} SELECT doc_id, type, count(*) FILTER (starts) AS n, sum(length(line))::BIGINT AS n_chars FROM m GROUP BY ALL",
    "md_tables": rf"""
WITH {_marked(False)}, {_TABLES}
SELECT d.doc_id, coalesce(n_tables, 0) AS n_tables, CASE WHEN coalesce(filled, 0) = 0 THEN 'NO_TABLE' WHEN split THEN 'SPLIT_TABLE' ELSE 'SIMPLE_TABLE' END AS kind,
  len(regexp_extract_all(coalesce(text, ''), '(?i)<(table|tr|td|th)\b'))::INT AS n_tags,
  len(list_filter(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x: length(x) > 40 AND regexp_matches(x, '\S+\s{{3,}}\S+\s{{3,}}\S+')))::INT AS n_aligned
FROM documents d LEFT JOIN w USING (doc_id)""",
    "md_statistics": f"""
WITH {_marked(True)}, e AS (SELECT doc_id, {", ".join(f"count(*) FILTER (starts AND type = '{k}')::INT AS n_{k}, coalesce(sum(length(line)) FILTER (type = '{k}'), 0)::INT AS {k}_chars" for k in blocks.KINDS)} FROM m GROUP BY doc_id),
f AS (SELECT * FROM (WITH {_marked(False)}, {_TABLES} SELECT * FROM w))
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}, coalesce({k}_chars, 0) AS {k}_chars" for k in blocks.KINDS)}, coalesce(n_rows, 0) AS n_rows,
  {_ROUGH.format("length(text)")} AS flat_chunks, CASE WHEN prose_chars + header_chars > 0 THEN {_ROUGH.format("prose_chars + header_chars")} ELSE 0 END + coalesce(chunks, 0) AS element_chunks
FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "page_facts": r"""
SELECT page_id, trim(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>([^<]*)</title>', 1)) AS title, """
    + ", ".join(_COUNT.format(t) for t in ("img", "a", "iframe", "table", "select", "li"))
    + """, concat_ws(',', CASE WHEN regexp_matches(html, '(?i)<nav') THEN '<nav' END, CASE WHEN regexp_matches(html, '(?i)charset=') THEN 'charset=' END,
  CASE WHEN regexp_matches(html, '(?i)id=.app') THEN 'id=.app' END, CASE WHEN regexp_matches(html, '(?i)<table') THEN '<table' END) AS markers FROM pages""",
    "question_collisions": f"WITH {_COLLISIONS} SELECT * FROM c",
    "collision_severity": f"WITH {_COLLISIONS} SELECT severity, count(*) AS n_questions, sum(n)::BIGINT AS n_chunks FROM c GROUP BY 1",
    "collision_summary": f"""
WITH {_COLLISIONS}, b AS (SELECT count(*) AS n_questions, count(DISTINCT question) AS n_unique, count(DISTINCT doc_id) AS n_keys,
    count(DISTINCT doc_id) FILTER (question IN (SELECT question FROM c)) AS n_affected FROM q)
SELECT n_questions, n_unique, n_keys, n_affected, n_colliding, round(n_colliding / greatest(1, n_unique) * 100, 1) AS rate_pct,
  round(n_affected / greatest(1, n_keys) * 100, 1) AS affected_pct FROM b, (SELECT count(*) AS n_colliding FROM c)""",
    "collision_impact": f"WITH {_COLLISIONS} SELECT count(*) FILTER (cross_page) AS cross_page, count(*) FILTER (NOT cross_page) AS within_page, coalesce(sum(slots), 0)::BIGINT AS slots FROM c",
    "dangerous_questions": f"WITH {_COLLISIONS} SELECT question, n, n_urls, severity FROM c WHERE cross_page AND n >= 4 ORDER BY n DESC, question LIMIT 50",
    "collisions_by_language": f"WITH {_COLLISIONS} SELECT lang, count(*) AS n FROM q WHERE question IN (SELECT question FROM c) GROUP BY 1",
    "priority_dedup": f"""
WITH {_LISTED}, p AS (SELECT *, CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS page_class, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS first, doc_id % 5 AS i FROM q),
r AS (SELECT *, count(*) OVER (PARTITION BY question) AS n, first_value(doc_id) OVER (PARTITION BY question ORDER BY page_class, first, i, doc_id) AS keeper FROM p),
m AS (SELECT doc_id, bool_or(n > 3 AND keeper <> doc_id) AS changed, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (n <= 3 OR keeper = doc_id), '') AS new FROM r GROUP BY 1)
SELECT d.doc_id AS chunk_id, md5(CASE WHEN m.changed THEN m.new ELSE coalesce(d.text, '') END) AS questions_md5 FROM documents d LEFT JOIN m USING (doc_id)""",
    "seed_questions": rf"""
WITH s AS (SELECT doc_id, coalesce(lang, 'general') AS product_category, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
    lambda x: {STRIPPED.format("regexp_replace(" + STRIPPED.format('x') + r", '^[-*•\s]+', '')")}), lambda x: length(x) > 5) AS qs FROM documents WHERE coalesce(source, '') <> ''),
u AS (SELECT *, unnest(qs) AS question, generate_subscripts(qs, 1) AS i FROM s),
n AS (SELECT *, {STRIPPED.format("regexp_replace(lower(question), '[^a-z0-9 ]', '', 'g')")} AS norm FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, i) AS k FROM n WHERE norm <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS j FROM f WHERE k = 1)
SELECT source AS source_url, doc_id AS chunk_id, product_category, md5(question) AS question_md5 FROM r WHERE j <= 20""",
    "question_quality": rf"""
WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS q, text AS t, lower(split_part(text, chr(10), 1)) AS low FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, len(list_filter(string_split({COLLAPSED.format('q')}, ' '), lambda w: w <> '')) AS n,
  {STRIPPED.format("regexp_replace(" + STRIPPED.format('low') + ", '[?!.,;:]+$', '')")} AS plain,
  len(list_filter(list_transform(list_filter(string_split({COLLAPSED.format('t')}, ' '), lambda w: length(w) > 3 AND lower(w) NOT IN ({', '.join(f"'{w}'" for w in questions.STOP)})),
    lambda w: regexp_replace(lower(w), '^[.,?!:;()\[\]"'']+|[.,?!:;()\[\]"'']+$', '', 'g')), lambda w: contains(low, w))) > 0 AS grounded,
  array_to_string({TOKENS.format('q')}, ' ') AS nq, array_to_string({TOKENS.format('t')}, ' ') AS nt FROM d),
b AS (SELECT *, plain IN ({', '.join(f"'{w}'" for w in questions.BLOCKED)}) AS blocked, regexp_matches({STRIPPED.format('low')}, '({")|(".join(questions.GENERIC)})') AS generic FROM g)
SELECT doc_id, CASE WHEN blocked OR NOT grounded OR n < 5 OR generic THEN 0 WHEN contains(low, 'er') OR contains(low, 'qu') THEN 2 ELSE 1 END AS score,
  NOT blocked AND grounded AND n BETWEEN 1 AND 12 AS is_title, length(q) BETWEEN 8 AND 220 AS is_valid, length(nq) >= 20 AND contains(nt, nq) AS is_evidence FROM b""",
    "category_sample": """
WITH r AS (SELECT doc_id, coalesce(source, 'none') AS source, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, source FROM r WHERE n <= 5 ORDER BY n, source LIMIT 60""",
    "low_signal": f"""
SELECT role, count(*) AS n_turns FROM conversations WHERE role <> 'system' AND
  len(list_filter(string_split({STRIPPED.format("regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', '', 'g')")}, ' '), lambda w: w <> '')) >= 5 GROUP BY 1""",
    "top_terms": f"""
WITH w AS (SELECT doc_id, unnest({TOKENS.format('left(text, 6000)')}) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) > 3 AND w NOT IN ({', '.join(f"'{s}'" for s in questions.TOPIC_STOP)}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS k FROM c)
SELECT doc_id, string_agg(w, ',' ORDER BY w) AS terms FROM r WHERE k <= 30 GROUP BY 1""",
    "product_pages": """
WITH d AS (SELECT doc_id, lower('https://x/a/' || coalesce(source, 'none') || ' ' || coalesce(lang, '')) AS head, lower(left(coalesce(text, ''), 6000)) AS body, length(coalesce(text, '')) AS n FROM documents),
s AS (SELECT *, CASE WHEN contains(head, 'en') THEN 3 ELSE 0 END + CASE WHEN contains(head, 'the') THEN 3 ELSE 0 END + CASE WHEN contains(head, 'src1') THEN 3 ELSE 0 END
  + least(10, floor((len(regexp_extract_all(body, 'en')) + len(regexp_extract_all(body, 'the')) + len(regexp_extract_all(body, 'src1'))) / 3))::INT AS score FROM d)
SELECT doc_id, score FROM s WHERE n >= 600 AND score >= 3""",
}
