"""Text forms, similarity and rules over texts, all as columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W

#: White space at both ends, of any kind; a run of it is tried once only.
_ENDS = r"(?U)^[\s\x1c-\x1f]++|[\s\x1c-\x1f]++$"
#: What isn't white space.
FILLED = r"(?U)[^\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def collapsed(c: Column) -> Column:
    """With white space of any kind as one blank, and none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(collapsed(c), " "), lambda w: w != ""))


def bound(value, fn):
    """fn(value) with value computed once: a chain of steps that each use the last one twice stays as long as it is."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def has_any(text: Column, phrases) -> Column:
    """Whether text contains any of phrases, as they stand. Text stands in the plan once, and is computed once."""
    if not phrases:
        return F.lit(False)
    listed = F.array(*[F.lit(p) for p in phrases])
    return bound(text, lambda t: F.exists(listed, lambda p: t.contains(p)))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def alnum_words(text: Column) -> Column:
    """The lower-case runs of [a-z0-9], in order."""
    return F.regexp_extract_all(F.lower(_text(text)), F.lit("([a-z0-9]+)"), F.lit(1))


def norm_text(text: Column) -> Column:
    return F.array_join(alnum_words(text), " ")


def norm_question(text: Column) -> Column:
    """Lower case, without the punctuation at the very end, one blank between words."""
    return collapsed(F.regexp_replace(strip(F.lower(_text(text))), "[?!.,;:]+$", ""))


def same_question(text: Column) -> Column:
    """One blank between words, without question marks at the end, case folded: what tells questions apart. Folding is by lower case,
    with sharp s as ss."""
    return F.replace(F.lower(strip(F.regexp_replace(collapsed(_text(text)), r"\?+$", ""))), F.lit("ß"), F.lit("ss"))


def bare_question(text: Column) -> Column:
    """Lower case, letters a to z, digits and blanks only."""
    return strip(F.regexp_replace(F.lower(_text(text)), "[^a-z0-9 ]", ""))


def split_questions(raw: Column) -> Column:
    """The lines of raw as questions: without bullets and blanks in front, of more than 5 characters."""
    lines = F.transform(F.split(_text(raw), "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[-*•\s]+", "")))
    return F.filter(lines, lambda x: F.length(x) > 5)


def sanitized(text: Column) -> Column:
    """Without tags and control characters, with white space as one blank."""
    out = F.regexp_replace(_text(text), "<[^>]+>", "")
    return collapsed(F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def question_id(question: Column) -> Column:
    return F.concat(F.lit("q-"), F.substring(F.sha1(same_question(question)), 1, 10))


def chunk_id(identity: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", identity, index.cast("string"), _text(text)), 256)


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the overlap of two texts' sets of words; 0 if either is empty."""
    x, y = F.array_distinct(alnum_words(a)), F.array_distinct(alnum_words(b))
    return F.coalesce(2.0 * F.size(F.array_intersect(x, y)) / F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(x) + F.size(y)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def first_failure(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The reason of the first (reason, pattern) that text matches; null if it passes all."""
    out = None
    for reason, pattern in rules:
        hit = _text(text).rlike(pattern)
        out = F.when(hit, reason) if out is None else out.when(hit, reason)
    return F.lit(None).cast("string") if out is None else out


def failures(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The reasons of all rules that text matches, in their order."""
    return F.array_compact(F.array(*[F.when(_text(text).rlike(p), F.lit(r)) for r, p in rules])) if rules else F.array().cast("array<string>")


def citations(text: Column, n_sources: int) -> Column:
    """The numbers n of the marks [n], in order of first appearance, from 1 to n_sources."""
    marks = F.transform(F.regexp_extract_all(_text(text), F.lit(r"\[([0-9]{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(marks, lambda n: (n >= 1) & (n <= n_sources)))


def without_citations(text: Column) -> Column:
    """Without marks [n]; runs of white space are one blank."""
    return strip(F.regexp_replace(F.regexp_replace(_text(text), r"\[[0-9]+\]", ""), r"(?U)\s{2,}", " "))


def first_filled(*fields: Column) -> Column:
    """The first of fields that holds more than blanks."""
    return F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields])


def size_bucket(n_words: Column, small: int = 300, large: int = 700) -> Column:
    return F.when(n_words < small, "short").when(n_words > large, "long").otherwise("medium")


def severity(n: Column) -> Column:
    """Of a question that n chunks share. 4, 11 and 21."""
    return F.when(n >= 21, "critical").when(n >= 11, "high").when(n >= 4, "medium").otherwise("low")


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(_text(html), r"(?is)<title[^>]*>([^<]*)</title>", 1))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def sequence_similarity(a: Column, b: Column) -> Column:
    """The ratio of matching blocks (Ratcliff and Obershelp) of two lower-cased texts; 0 if either is empty. In Arrow batches."""
    return F.pandas_udf(_ratio, "double")(F.lower(_text(a)), F.lower(_text(b)))


def _best_part(short: str, long: str) -> float:
    """The best ratio of short and a stretch of long that is as long, among those that begin where a block matches."""
    if len(short) > len(long):
        short, long = long, short
    best = 0.0
    for i, j, _ in SequenceMatcher(None, short, long).get_matching_blocks():
        begin = max(0, j - i)
        best = max(best, SequenceMatcher(None, short, long[begin : begin + len(short)]).ratio())
    return best


def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_best_part(x, y) if x and y else 0.0 for x, y in zip(a, b, strict=True)])


def partial_similarity(a: Column, b: Column) -> Column:
    """How well the shorter of two lower-cased texts is found in the longer, 0 to 1."""
    return F.pandas_udf(_partial, "double")(F.lower(strip(_text(a))), F.lower(strip(_text(b))))


def refused(flag: Column, answer: Column, phrases=W.REFUSALS) -> Column:
    """The given flag, else whether the answer has a phrase of refusal."""
    return F.coalesce(flag, has_any(F.lower(_text(answer)), phrases))


def clean_answer(text: Column) -> Column:
    """Without horizontal rules, lines in single asterisks unwrapped, no white space at line ends, at most one empty line together."""
    rule = r"^[-*_]{3,}$"

    def line(x):
        bare = strip(x)
        wrapped = bare.startswith("*") & bare.endswith("*") & ~bare.startswith("**") & ~bare.startswith("* ") & (F.length(bare) > 1)
        return F.when(wrapped, F.replace(x, bare, F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(x)

    kept = F.filter(F.split(_text(text), "\n"), lambda x: ~strip(x).rlike(rule))
    lines = F.transform(kept, lambda x: F.regexp_replace(line(x), r"(?U)\s+$", ""))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def without_history(prompt: Column) -> Column:
    """Without the block of earlier conversation that a prompt begins with."""
    return F.regexp_replace(_text(prompt), r"(?s)^Previous conversation:\n.*?\n\n", "")


def content_filter(error: Column) -> Column:
    """Struct (fired, category) of an error message of a model's content filter; the category that was detected, if it can be read."""
    plain = F.replace(_text(error), F.lit('"'), F.lit("'"))
    fired = plain.contains("content_filter")
    found = F.lit(None).cast("string")
    for c in reversed(("jailbreak", "violence", "hate", "self_harm", "sexual")):
        hit = plain.rlike(rf"'{c}':\s*\{{[^}}]*?(?:'detected':\s*True|'severity':\s*'(?!safe)\w+')")
        found = F.when(hit, c).otherwise(found)
    return F.struct(fired.alias("fired"), F.when(fired, found).alias("category"))


def boolean(value: Column, default: bool = False) -> Column:
    """true, yes, y, 1 and false, no, n, 0 in any case; the default for "", null for all else."""
    low = F.lower(_text(value))
    return F.when(low == "", F.lit(default)).when(low.isin("true", "yes", "y", "1"), F.lit(True)).when(low.isin("false", "no", "n", "0"), F.lit(False))


def position_bucket(index: Column, total: Column) -> Column:
    return F.when(index == 0, "first").when((total > 1) & (index == total - 1), "last").otherwise("middle")


def citations_renumbered(text: Column, urls: Column) -> Column:
    """Struct (text, cited): marks [n] of text numbered anew by first appearance, and the places in urls (from 1) that they stand for. A
    mark out of range, or of a url that is cited already, is no citation: it is removed, and blanks around it are one."""
    marks = F.array_distinct(F.transform(F.regexp_extract_all(_text(text), F.lit(r"\[([0-9]{1,6})\]"), F.lit(1)), lambda x: x.cast("int")))
    known = F.filter(marks, lambda n: (n >= 1) & (n <= F.size(urls)))
    same = lambda n, m: F.element_at(urls, n) == F.element_at(urls, m)
    cited = F.filter(known, lambda n, i: ~F.exists(F.slice(known, F.lit(1), i), lambda m: same(n, m)))
    parts = F.split(_text(text), r"(?<=\])|(?=\[[0-9])")

    def shown(part):
        n = F.regexp_extract(part, r"^\[([0-9]{1,6})\]$", 1)
        place = F.when(n != "", F.array_position(cited, n.try_cast("int")))
        is_mark = part.rlike(r"^\[[0-9]+\]$")
        return F.when(is_mark & (F.coalesce(place, F.lit(0)) > 0), F.concat(F.lit("["), place.cast("string"), F.lit("]"))).when(is_mark, F.lit("")).otherwise(part)

    made = F.regexp_replace(F.array_join(F.transform(parts, shown), ""), " {2,}", " ")
    return F.struct(F.when(F.size(marks) > 0, made).otherwise(_text(text)).alias("text"), cited.alias("cited"))


def static_citations(cited: Column, links: list[tuple[str, str]]) -> Column:
    """cited (array of struct: index, url, title) with those of links (url, title) that it lacks, numbered on."""
    out = F.coalesce(cited, F.array().cast("array<struct<index:int,url:string,title:string>>"))
    for url, title in links:
        after = F.coalesce(F.array_max(F.transform(out, lambda c: c["index"])), F.lit(0)) + 1
        more = F.concat(out, F.array(F.struct(after.cast("int").alias("index"), F.lit(url).alias("url"), F.lit(title).alias("title"))))
        out = F.when(F.array_contains(F.transform(out, lambda c: c["url"]), url), out).otherwise(more)
    return out
