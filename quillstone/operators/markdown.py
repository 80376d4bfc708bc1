"""Markdown: cleaning rules and looks at lines, as expressions, and what changed between versions. Elements and chunks: blocks.py."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: The size of a chunk and its overlap, in characters, the rows of a table in one chunk, and the places to split at.
SIZE, OVERLAP, TABLE_ROWS = 1600, 200, 30
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Texts shorter than this are no chunk, and pages none.
LEAST = 50

#: Name, pattern and replacement of the cleaning rules, in their order.
NOISE = (
    ("breadcrumb", r"(?m)(?:^\s*\d+\.\s*\[.*?\]\(.*?\)\s*>\s*$\s*)+^\s*\d+\.\s+[A-Z][^\n]{3,60}$", ""),
    ("breadcrumb_line", r"(?m)^\s*\d+\.\s*\[.*?\]\(.*?\)\s*>\s*$", ""),
    ("share_block", r"Share\s*\n(\s*\*\s*(\[?\s*\]?\([^\)]*\))?\s*\n)+", ""),
    ("empty_bullet_link", r"(?m)^\s*\*\s*\[?\s*\]?\(\s*[^\)]{0,10}\)\s*$", ""),
    ("share_line", r"(?m)^Share\s*$", ""),
    ("tweet_link", r"\[?\s*\]?\(https://twitter\.com/intent/tweet[^\)]*\)\s*", ""),
    ("social_urls", r"https://www\.(facebook|instagram|linkedin|x|youtube|twitter)\.com/\S+", ""),
    ("empty_link", r"\[\s*\]\(\s*\)", ""),
    ("empty_bullet", r"(?m)^\s*\*\s*\[\s*\]\s*$", ""),
    ("prev_next_item", r"(?mi)^(Previous Item|Next Item)\s*$", ""),
    ("browser_not_supported", r"(?s)Your browser is not supported\..*?×\s*", ""),
    ("back_to_top", r"\[Back to top\].*?\n", ""),
    ("latest_news", r"(?sm)^#{1,3}[ \t]*Latest news[ \t]*$.*", ""),
)
_SPACES = ((r"\n{3,}", "\n\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+\n", "\n\n"))


def without_second_copy(content: Column) -> Column:
    """Cut at the second heading of level 1 or 2, if it begins past 40 % of the text and more than 60 % of the different words among
    the first 200 before it are among the first 200 from it on."""
    parts = F.split(content, r"(?m)(?=^#{1,2}\s+\S)")
    heads = r"^#{1,2}\s+\S"
    lead = F.when(F.element_at(parts, 1).rlike(heads), 1).otherwise(2)  # parts before the second heading
    first = F.array_join(F.slice(parts, F.lit(1), lead), "")
    second = F.substring(content, F.length(first) + 1, F.length(content))
    words = lambda c: F.array_distinct(F.slice(F.filter(F.split(T.collapsed(c), " "), lambda w: w != ""), 1, 200))
    a, b = words(first), words(second)
    copied = (F.size(F.array_intersect(a, b)) / F.when(F.size(a) > 0, F.size(a))) > 0.6
    cut = (F.size(parts) > lead) & (F.length(first) >= 0.4 * F.length(content)) & F.coalesce(copied, F.lit(False))
    return F.when(cut, T.strip(first)).otherwise(content)


def cleaned(content: Column) -> Column:
    """Without boilerplate: a second copy of the text, then NOISE rule by rule, then superfluous white space."""
    out = without_second_copy(F.coalesce(content, F.lit("")))
    for _, pattern, new in NOISE:
        out = F.regexp_replace(out, pattern, new)
    for pattern, new in _SPACES:
        out = F.regexp_replace(out, pattern, new)
    return T.strip(out)


def cleaning_losses(content: Column) -> list[Column]:
    """How many characters each cleaning rule removes, in the order of the rules."""
    now = F.coalesce(content, F.lit(""))
    after = without_second_copy(now)
    out = [(F.length(now) - F.length(after)).alias("second_copy")]
    for name, pattern, new in NOISE:
        now, after = after, F.regexp_replace(after, pattern, new)
        out.append((F.length(now) - F.length(after)).alias(name))
    return out


def without_foreign_links(text: Column, own: str) -> Column:
    """Without urls that don't contain own: a link keeps its text, a bare url goes; then blanks are one."""
    host = re.escape(own)
    out = F.regexp_replace(F.coalesce(text, F.lit("")), rf"\[([^\]]+)\]\((?!https?://[^\)]*{host})https?://[^\)]+\)", "$1")
    out = F.regexp_replace(out, rf"(?!https?://[^\s\)\]\"'<>,]*{host})https?://[^\s\)\]\"'<>,]+", "")
    return T.strip(F.regexp_replace(out, "  +", " "))


def without_links(text: Column) -> Column:
    """Images go, links become their text, white space is tidied."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1"), "[ \\t]+", " ")
    return T.strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def cut_at(content: Column, markers: list[str], least: int = 100) -> Column:
    """Cut before the first of markers, in any case, if at least that many characters remain."""
    low = F.lower(content)
    places = F.filter(F.array(*[F.locate(m, low) for m in markers]), lambda p: p > 0)
    head = T.strip(F.substring(content, F.lit(1), F.array_min(places) - 1))
    return F.when((F.size(places) > 0) & (F.length(head) >= least), head).otherwise(content)


# Looks at lines -------------------------------------------------------------------------------------------------------------------


def split_severity(n_rows: Column) -> Column:
    return F.when(n_rows > 10, "HIGH").otherwise("LOW")


def html_tags_left(content: Column) -> Column:
    """How many tags of tables stand in the text."""
    return F.regexp_count(content, F.lit(r"(?i)<(table|tr|td|th)\b"))


def aligned_lines(content: Column) -> Column:
    """How many lines of more than 40 characters have three columns with wide gaps."""
    return F.size(F.filter(F.split(content, r"\r?\n"), lambda x: (F.length(x) > 40) & x.rlike(r"\S+\s{3,}\S+\s{3,}\S+")))


def priced_rows(content: Column, size: int = SIZE, overlap: int = OVERLAP, price: str = r"\d+\.\d+p", skip: str = r"fund name|sedol|bid price") -> Column:
    """Lines of tables with a price: array of struct (line, start_chunk, end_chunk), chunks being fixed windows from 0; a row is torn
    where they differ."""
    step = size - overlap
    lines = F.split(content, r"(?<=\n)")
    ends = F.aggregate(lines, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    window = lambda at: F.greatest(F.lit(0), F.ceil((at - size + 1) / step)).cast("int")
    row = lambda x, i: F.struct(
        (i + 1).alias("line"), window(F.element_at(ends, i + 1)).alias("start_chunk"), window(F.element_at(ends, i + 2) - 1).alias("end_chunk"), T.strip(x).alias("text")
    )
    good = lambda r: r["text"].startswith("|") & r["text"].rlike(price) & ~F.lower(r["text"]).rlike(skip)
    return F.filter(F.transform(lines, row), good)


#: Words that a question begins with.
QUESTION_WORDS = ("what", "how", "why", "when", "can", "do", "does", "is", "are", "will", "should", "could", "would", "who", "which")


def is_question_like(header: Column, words=QUESTION_WORDS) -> Column:
    low = T.strip(F.lower(header))
    return low.endswith("?") | F.split(low, r"\s+")[0].isin(*words)


def accordion_runs(rows: DataFrame, key: str) -> DataFrame:
    """Runs of three or more pairs of a question-like header and prose, of rows (key, pos, type, text, n_chars) of elements without blank ones:
    key, run, n, n_headers, mean_chars, spread and consistent."""
    w = Window.partitionBy(key).orderBy("pos")
    good = (F.col("type") == "header") & is_question_like(F.col("text")) & (F.lead("type").over(w) == "prose")
    marked = rows.withColumn("_q", F.coalesce(good, F.lit(False))).withColumn("_body", F.lead("n_chars").over(w))
    marked = marked.withColumn("_in", F.col("_q") | F.coalesce(F.lag("_q").over(w) & (F.col("type") == "prose"), F.lit(False)))
    marked = marked.withColumn("run", F.sum((~F.col("_in")).cast("int")).over(w)).filter("_q")
    out = marked.groupBy(key, "run").agg(F.count("*").alias("n"), F.count_distinct(F.lower(F.trim("text"))).alias("n_headers"), F.avg("_body").alias("mean_chars"), F.stddev_samp("_body").alias("spread"))
    steady = F.coalesce(F.col("spread"), F.lit(0.0)) / F.when(F.col("mean_chars") > 0, F.col("mean_chars")) < 1.5
    return out.filter("n >= 3").withColumn("consistent", F.coalesce(steady, F.lit(False)) & (F.col("n_headers") / F.col("n") >= 0.7))


def headings_found(content: Column, labels: list[str]) -> Column:
    """Array of struct (label, place) of the labels that stand in content as a heading of level 1 to 4, or in bold; places from 1."""
    out = []
    for label in labels:
        name = re.escape(label)
        heading, bold = rf"(?i)(?:^|\n)\s*#{{1,4}}\s*{name}\s*(?:\n|$)", rf"(?i)(?:^|\n)\s*\*\*{name}\*\*"
        place = F.when(content.rlike(heading), F.regexp_instr(content, F.lit(heading))).when(content.rlike(bold), F.regexp_instr(content, F.lit(bold)))
        out.append(F.struct(F.lit(label).alias("label"), place.alias("place")))
    return F.filter(F.array(*out), lambda x: x["place"].isNotNull())


def numbered_lines(content: Column) -> Column:
    """Array of struct (line, text) of the lines that aren't empty, white space as one blank, with their numbers from 1."""
    rows = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r\n|\n|\r"), lambda x, i: F.struct((i + 1).alias("line"), T.collapsed(x).alias("text")))
    return F.filter(rows, lambda r: r["text"] != "")


def digest(content: Column) -> Column:
    """12 hex digits of the text's lines."""
    return F.substring(F.sha2(F.array_join(F.transform(numbered_lines(content), lambda r: r["text"]), "\n"), 256), 1, 12)


def section_digests(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, header and digest of each section: the lines up to the next heading; (top) before the first. Sections of one heading are one."""
    lines = rows.select(key, F.posexplode(numbered_lines(F.col(content))).alias("pos", "l")).select(key, "pos", "l.text")
    head = F.when(F.col("text").rlike(r"^#{1,6}\s"), F.col("text"))
    named = lines.withColumn("header", F.coalesce(F.last(head, ignorenulls=True).over(Window.partitionBy(key).orderBy("pos")), F.lit("(top)")))
    body = F.sort_array(F.collect_list(F.when(~F.col("text").rlike(r"^#{1,6}\s"), F.struct("pos", "text"))))  # a page's lines
    return named.groupBy(key, "header").agg(F.sha2(F.array_join(F.transform(body, lambda x: x["text"]), "\n"), 256).alias("digest"))


def section_changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, header and change (added, removed or modified) between two versions of pages."""
    a, b = section_digests(old, key, content).withColumnRenamed("digest", "_a"), section_digests(new, key, content).withColumnRenamed("digest", "_b")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, [key, "header"], "full_outer").select(key, "header", change.alias("change")).filter("change IS NOT NULL")
