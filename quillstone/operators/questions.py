"""Questions that chunks carry: collisions, quality, dedup, seeds, samples, and the agreement and cost of models that grade them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..storage import materialise

#: Words that don't ground a question, patterns and terms that say how specific it is, and the rules below.
STOP = tuple(
    """the a an is are was were in on at to for of and or but it this that with my your our i we you they be do have will can could would
    should may might from by as if when what how about which there their than then""".split()
)
TOPIC_STOP = tuple(
    """the a an and or of to in for on with is are be by at as it that this from your you our we can will if not have has how what when who which
    more about their they there""".split()
)
GENERIC = (
    r"^what is (insurance|a pension|an isa)\??$", r"^how do (pensions|isas|policies) work\??$", r"^tell me about", r"^explain ", r"^how can (i|you) help",
)
TERMS = (
    "pension", "isa", "insurance", "protection", "annuity", "drawdown", "premium", "policy", "benefit", "contribution", "allowance", "claim",
    "bereavement", "life cover", "critical illness", "income protection", "whole of life", "term insurance", "workplace", "personal pension",
    "sipp", "financial adviser", "retirement", "surrender",
)
BLOCKED = (
    "how can i save money on my energy bills", "what state benefits can i get if im struggling", "how do i save money on my household bills",
    "how can i create a budget to save money", "how can i pay off my credit cards faster", "what tips do you have for monitoring my spending",
    "what tips do you have for building an emergency fund", "how can i find guides on saving and budgeting",
)
#: A question may stand in as many places; words of a title question at most; critical collisions and the places of a result.
PLACES, TITLE_WORDS, TOP = 3, 12, 5
PRICES = (
    ("gpt-5-mini", 1.25, 5.0), ("gpt-5-nano", 0.5, 2.0), ("gpt-5.1", 2.0, 8.0), ("gpt-5", 2.0, 8.0), ("gpt-4o-mini", 0.15, 0.6),
    ("gpt-4o", 2.5, 10.0), ("gpt-4.1", 2.0, 8.0),
)


def listed(chunks: DataFrame, field: str) -> DataFrame:
    """A row for each line of field that isn't blank: the chunk's columns, pos and question."""
    lines = F.filter(F.transform(F.split(F.coalesce(field, F.lit("")), "\n"), T.strip), lambda q: q != "")
    return chunks.select("*", F.posexplode(lines).alias("pos", "question"))


def collisions(questions: DataFrame, key: str, url: str, limit: int = TOP) -> DataFrame:
    """question (normal form), n (different keys), n_urls, severity, cross_page and slots (places of a result that it takes, if it is critical and
    on several pages) of the questions (key, url, question) that two keys or more have. Pairs are counted before they meet."""
    normal = questions.select(T.norm_question(F.col("question")).alias("question"), key, url)
    per_key = normal.groupBy("question", key).agg(F.min(url).alias("_u"))
    out = per_key.groupBy("question").agg(F.count("*").alias("n"), F.count_distinct("_u").alias("n_urls")).filter("n > 1")
    cross = F.col("n_urls") > 1
    slots = F.when(cross & (F.col("n") >= 21), F.least(F.col("n"), F.lit(limit))).otherwise(0)
    return out.select("question", "n", "n_urls", T.severity(F.col("n")).alias("severity"), cross.alias("cross_page"), slots.cast("long").alias("slots"))


def collision_summary(questions: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: n_questions, n_unique, n_colliding, rate_pct, n_keys and affected_pct (keys with a colliding question)."""
    normal = questions.select(key, T.norm_question(F.col("question")).alias("question"))
    hit = normal.join(found.select("question"), "question", "left_semi").agg(F.count_distinct(key).alias("n_affected"))
    base = normal.agg(F.count("*").alias("n_questions"), F.count_distinct("question").alias("n_unique"), F.count_distinct(key).alias("n_keys"))
    out = base.crossJoin(hit).crossJoin(found.agg(F.count("*").alias("n_colliding")))  # one row each
    pct = lambda a, b: F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)) * 100, 1)
    return out.withColumn("rate_pct", pct("n_colliding", "n_unique")).withColumn("affected_pct", pct("n_affected", "n_keys"))


def collision_impact(found: DataFrame) -> DataFrame:
    """One row of collisions()'s result: cross_page and within_page questions, and slots that critical ones take."""
    return found.agg(F.count_if("cross_page").alias("cross_page"), F.count_if(~F.col("cross_page")).alias("within_page"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots"))


def dangerous(found: DataFrame, limit: int = 50) -> DataFrame:
    """The questions on several pages that four keys or more have, those of most keys first: a report of at most limit rows."""
    return found.filter("cross_page AND n >= 4").orderBy(F.desc("n"), "question").limit(limit)


def collisions_by(questions: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """kind and how many occurrences of colliding questions it has."""
    normal = questions.withColumn("question", T.norm_question(F.col("question")))
    return normal.join(found.select("question"), "question", "left_semi").groupBy(kind).agg(F.count("*").alias("n"))


def is_grounded(question: Column, content: Column, stop=STOP) -> Column:
    """Whether the question contains any word of the content of more than 3 letters that isn't a stop word."""
    words = F.filter(F.split(T.collapsed(content), " "), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*stop))
    bare = F.array_distinct(F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,?!:;()\[\]\"']+|[.,?!:;()\[\]\"']+$", "")))
    return F.exists(bare, lambda w: F.lower(question).contains(w))


def is_specific(question: Column, generic=GENERIC) -> Column:
    """Five words or more, and none of the generic patterns."""
    low = F.lower(T.strip(question))
    return (T.n_words(question) >= 5) & ~low.rlike("(" + ")|(".join(generic) + ")")


def question_score(question: Column, content: Column, terms=TERMS, blocked=BLOCKED) -> Column:
    """0 if it is blocked, not grounded or not specific; 2 with a term of the trade; else 1."""
    plain = T.strip(F.regexp_replace(T.strip(F.lower(question)), "[?!.,;:]+$", ""))
    bad = plain.isin(*blocked) | ~is_grounded(question, content) | ~is_specific(question)
    return F.when(bad, 0).when(T.has_any(F.lower(question), terms), 2).otherwise(1)


def is_title_question(question: Column, content: Column, blocked=BLOCKED, most: int = TITLE_WORDS) -> Column:
    """Not blocked, grounded, and of at most that many words."""
    plain = T.strip(F.regexp_replace(T.strip(F.lower(question)), "[?!.,;:]+$", ""))
    return ~plain.isin(*blocked) & is_grounded(question, content) & T.n_words(question).between(1, most)


def is_valid_generated(question: Column, banned: str | None = None) -> Column:
    """Of 8 to 220 characters, without the banned pattern."""
    out = F.length(question).between(8, 220)
    return F.coalesce(out & ~question.rlike(banned) if banned else out, F.lit(False))


def is_evidence(evidence: Column, text: Column) -> Column:
    """Whether evidence of 20 characters or more, in normal form, stands in the text."""
    e = T.norm_text(evidence)
    return (F.length(e) >= 20) & T.norm_text(text).contains(e)


def priority(url: Column, index: Column, generic=U.GENERAL) -> Column:
    """What keeps a question: pages of their own before others, general ones last; the first chunk, then by index."""
    low = F.lower(F.coalesce(url, F.lit("")))
    general = T.has_any(low, generic)
    page = F.when(U.is_dedicated(url) & ~general, 0).when(~general, 1).otherwise(2)
    i = F.coalesce(index, F.lit(999))
    return F.struct(page.alias("page"), F.when(i == 0, 1).otherwise(2).alias("first"), i.cast("long").alias("index"))


def dedup_questions(chunks: DataFrame, fields: tuple[str, ...] = ("title_questions", "augmented_questions"), places: int = PLACES, generic=U.GENERAL) -> DataFrame:
    """chunks (chunk_id, source_url, chunk_index, fields of newline lists) with every question that stands in more than `places` places of both
    fields together left only in the chunk of the best priority, the least chunk_id of equals. Fields without change stay as they are."""
    every = None
    for f in fields:
        rows = listed(chunks.select("chunk_id", "source_url", "chunk_index", f), f).select("chunk_id", F.lit(f).alias("field"), "pos", "question", priority(F.col("source_url"), F.col("chunk_index"), generic).alias("p"))
        every = rows if every is None else every.unionByName(rows)
    every = every.withColumn("norm", T.norm_question(F.col("question")))
    kept_in = every.groupBy("norm").agg(F.count("*").alias("n"), F.min(F.struct("p", "chunk_id")).alias("best")).filter(F.col("n") > places)
    marked = every.join(kept_in.select("norm", F.col("best.chunk_id").alias("keeper")), "norm", "left")
    gone = F.col("keeper").isNotNull() & (F.col("keeper") != F.col("chunk_id"))
    lists = marked.groupBy("chunk_id", "field").agg(F.bool_or(gone).alias("changed"), F.sort_array(F.collect_list(F.when(~gone, F.struct("pos", "question")))).alias("q"))
    lists = lists.filter("changed").withColumn("new", F.array_join(F.transform("q", lambda x: x["question"]), "\n"))
    out = chunks
    for f in fields:
        out = out.join(lists.filter(F.col("field") == f).select("chunk_id", F.col("new").alias("_new")), "chunk_id", "left").withColumn(f, F.coalesce("_new", f)).drop("_new")
    return out.select(*chunks.columns)


def seed_rows(chunks: DataFrame, per_url: int) -> DataFrame:
    """product_category, question, source_url, chunk_id and chunk_index of the first occurrence of every question, at most per_url of a url; by
    chunk order (column pos_in_index), title questions first. Parents' urls stand for those of variants."""
    lines = F.concat(T.split_questions(F.col("title_questions")), T.split_questions(F.col("augmented_questions")))
    url = U.citation_url(F.col("source_url"), F.col("parent_url"))
    rows = chunks.withColumn("source_url", url).filter("source_url <> ''").select("*", F.posexplode(lines).alias("_i", "question"))
    rows = rows.withColumn("_n", T.bare_question(F.col("question"))).filter("_n <> ''")
    order = F.struct("pos_in_index", "_i")
    firsts = rows.groupBy("_n").agg(F.min_by(F.struct("product_category", "question", "source_url", "chunk_id", "chunk_index", "pos_in_index", "_i"), order).alias("r")).select("r.*")
    w = Window.partitionBy("source_url").orderBy("pos_in_index", "_i")
    return firsts.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= per_url).drop("_k", "_i", "pos_in_index")


def embedding_text(content: Column, title_questions: Column, augmented_questions: Column) -> Column:
    """What is embedded of a chunk: its content, and its questions if it has any."""
    part = lambda c, name: F.when(T.strip(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name}:\n"), T.strip(c)))
    return F.concat_ws("\n\n", content, part(title_questions, "Entry-point questions this page answers"), part(augmented_questions, "Questions this answers"))


def by_category(rows: DataFrame, category: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the categories that are included, or else of those that aren't excluded."""
    c = T.strip(F.coalesce(category, F.lit("")))
    return rows.filter(c.isin(*include) if include else ~c.isin(*exclude) if exclude else F.lit(True))


def with_signal(rows: DataFrame, question: str, least: int = 5) -> DataFrame:
    return rows.filter(T.n_words(T.bare_question(F.col(question))) >= least)


def fuzzy_dedup(rows: DataFrame, category: str, question: str, order: str, threshold: float = 0.85) -> DataFrame:
    """rows without those whose question is like that of an earlier row of their category that stays: a ratio of matching blocks of at least
    the threshold. A category is read in order as a stream: what a task holds is what stays of one category."""
    plain = rows.withColumn("_q", T.bare_question(F.col(question))).withColumn("_c", F.coalesce(F.col(category), F.lit("")))
    names = rows.columns

    def run(batches):
        now, kept = None, []
        for batch in batches:
            good = []
            for c, q in zip(batch.column(len(names) + 1).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if c != now:
                    now, kept = c, []
                m = SequenceMatcher(None, "", q)  # what it prepares is of the second text, which stays
                ok = True
                for other in kept:
                    m.set_seq1(q), m.set_seq2(other)
                    if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
                        ok = False
                        break
                if ok:
                    kept.append(q)
                good.append(ok)
            yield batch.select(names).filter(pa.array(good, pa.bool_()))

    return plain.repartition("_c").sortWithinPartitions("_c", order).mapInArrow(run, rows.schema)


def round_robin(rows: DataFrame, category: str, order: str, target: int, per_category: int | None = None) -> DataFrame:
    """target rows, one of each category in turn (categories by name), in order within a category, at most per_category of each."""
    w = Window.partitionBy(category).orderBy(order)
    ranked = rows.withColumn("_n", F.row_number().over(w))
    ranked = ranked.filter(F.col("_n") <= min(target, per_category or target))
    return ranked.orderBy("_n", category).limit(target).drop("_n")


def stratified(rows: DataFrame, category: str, key: str, target: int, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """round_robin() of rows in an order that the seed decides, without those whose key is in exclude."""
    left = rows if exclude is None else rows.join(exclude.select(key).distinct(), key, "left_anti")
    return round_robin(left.withColumn("_r", F.xxhash64(F.lit(seed), F.col(key))), category, "_r", target).drop("_r")


def product_score(url: Column, title: Column, content: Column, terms: tuple[str, ...], most: int = 6000) -> Column:
    """3 for each term in the url or title, and a third of the occurrences in the first characters of the text, up to 10."""
    head, body = F.lower(F.concat_ws(" ", url, title)), F.lower(F.substring(content, 1, most))
    times = sum((F.regexp_count(body, F.lit(r"\Q" + t + r"\E")) for t in terms), F.lit(0))
    return sum((F.when(head.contains(t), 3).otherwise(0) for t in terms), F.lit(0)) + F.least(F.lit(10), F.floor(times / 3)).cast("int")


def eligible(pages: DataFrame, terms: tuple[str, ...], least_score: int, deny_url: str | None = None, deny_title: str | None = None, least: int = 600) -> DataFrame:
    """pages (url, title, content) with score, of those that aren't denied, two levels deep or more, long enough, with that score; best first."""
    score = product_score(F.col("url"), F.coalesce("title", F.lit("")), F.col("content"), terms)
    out = pages.filter(~F.col("url").rlike(deny_url)) if deny_url else pages
    out = out.filter(~F.coalesce("title", F.lit("")).rlike(deny_title)) if deny_title else out
    out = out.filter((F.size(U.segments(F.col("url"))) >= 2) & (F.length("content") >= least)).withColumn("score", score)
    return out.filter(F.col("score") >= least_score).orderBy(F.desc("score"), "url")


def top_terms(pages: DataFrame, key: str, text: str, n: int = 30, stop: tuple[str, ...] = TOPIC_STOP, most: int = 6000) -> DataFrame:
    """key and terms: the n most frequent words of more than 3 letters, stop words left out, the first by spelling of equals."""
    words = F.filter(T.alnum_words(F.substring(text, 1, most)), lambda w: (F.length(w) > 3) & ~w.isin(*stop))
    counted = pages.select(key, F.explode(words).alias("w")).groupBy(key, "w").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "w"))).filter(F.col("_r") <= n)
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("w")).alias("terms"))


def topic_pairs(pages: DataFrame, key: str, category: str, terms: str, n: int, least: float = 0.08) -> DataFrame:
    """The n pairs (a, b, likeness) of pages of one category that share most of their terms, each page in one pair at most, best first.

    Pages meet by the terms they share, so that no two without any are compared, but all that share a common one are: this is for pages by the
    thousand, as the choice of pairs to write questions about is. Then a pair is taken if it is the best that both of its pages
    have, until n are taken or none is left: what the one-by-one choice of the best pair takes, a round at a time."""
    rows = pages.select(key, category, F.explode(terms).alias("t"))
    size = pages.select(F.col(key).alias("k"), F.size(terms).alias("s"))
    met = rows.alias("x").join(rows.alias("y"), (F.col("x.t") == F.col("y.t")) & F.col(f"x.{category}").eqNullSafe(F.col(f"y.{category}")) & (F.col(f"x.{key}") < F.col(f"y.{key}")))
    met = met.groupBy(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).agg(F.count("*").alias("m"))
    both = met.join(size.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(size.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    pairs = both.select("a", "b", (F.col("m") / (F.col("sa") + F.col("sb") - F.col("m"))).alias("likeness")).filter(F.col("likeness") > least)
    pairs = materialise(pairs, "topic-pairs")
    taken, left, n_taken = None, pairs, 0
    while n_taken < n and left.limit(1).count():
        rank = F.struct(-F.col("likeness"), F.col("a"), F.col("b"))
        best = left.select(F.explode(F.array("a", "b")).alias("k"), rank.alias("r")).groupBy("k").agg(F.min("r").alias("r"))
        first = left.withColumn("r", rank).join(best.select(F.col("k").alias("a"), F.col("r").alias("ra")), "a").join(best.select(F.col("k").alias("b"), F.col("r").alias("rb")), "b")
        won = first.filter((F.col("r") == F.col("ra")) & (F.col("r") == F.col("rb"))).select("a", "b", "likeness")
        won = materialise(won, "topic-won")
        n_taken += won.count()
        taken = won if taken is None else taken.unionByName(won)
        used = won.select(F.explode(F.array("a", "b")).alias("k"))
        left = materialise(left.join(used, left["a"] == used["k"], "left_anti").join(used, F.col("b") == used["k"], "left_anti"), "topic-left")
    return (pairs if taken is None else taken).orderBy(F.desc("likeness"), "a", "b").limit(n)


def representative(chunks: DataFrame, target: int, weights: dict[str, float], order: str = "chunk_id") -> DataFrame:
    """target of chunks (chunk_id, content_type, size_category, position): first one each of long, medium, first and last, of the type that is named
    first in weights; then of each type its share of the places left, evenly spaced among its chunks from long to short."""
    types = list(weights)
    place = F.coalesce(*[F.when(F.col("content_type") == t, i) for i, t in enumerate(types)], F.lit(99))
    kind = [("size_category", "long"), ("size_category", "medium"), ("position", "first"), ("position", "last")]
    ranked = chunks.withColumn("_t", place)
    some = [ranked.filter(F.col(c) == v).orderBy("_t", order).limit(1).withColumn("_g", F.lit(i)) for i, (c, v) in enumerate(kind)]
    sure = some[0]
    for s in some[1:]:
        sure = sure.unionByName(s)
    sure = materialise(sure.dropDuplicates(["chunk_id"]), "sample-sure")
    left = target - sure.count()
    rest = ranked.join(sure.select("chunk_id"), "chunk_id", "left_anti").filter(F.col("_t") < len(types))
    size_rank = F.coalesce(*[F.when(F.col("size_category") == s, i) for i, s in enumerate(("long", "medium", "short"))], F.lit(2))
    pos_rank = F.coalesce(*[F.when(F.col("position") == s, i) for i, s in enumerate(("first", "last", "middle"))], F.lit(2))
    w = Window.partitionBy("content_type")
    rest = rest.withColumn("_i", F.row_number().over(w.orderBy(size_rank, pos_rank, order)) - 1).withColumn("_n", F.count("*").over(w))
    slots = F.coalesce(*[F.when(F.col("content_type") == t, max(1, round(left * x))) for t, x in weights.items()], F.lit(1))
    slots = F.least(slots, F.col("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / slots))
    spaced = rest.filter((F.col("_i") % step == 0) & (F.col("_i") / step < slots)).withColumn("_g", F.lit(9))
    both = sure.select(*chunks.columns, "_g", "_t", F.lit(0).cast("long").alias("_i")).unionByName(spaced.select(*chunks.columns, "_g", "_t", F.col("_i").cast("long").alias("_i")))
    return both.orderBy("_g", "_t", "_i", order).limit(target).select(*chunks.columns)


def classified(chunks: DataFrame) -> DataFrame:
    """chunks (content, chunk_index, total_chunks, augmented_questions) that have questions, with n_words, size_category and position."""
    some = chunks.filter(T.strip(F.coalesce("augmented_questions", F.lit(""))) != "").withColumn("n_words", T.n_words(F.coalesce("content", F.lit(""))))
    place = T.position_bucket(F.coalesce("chunk_index", F.lit(0)), F.coalesce("total_chunks", F.lit(1)))
    return some.withColumn("size_category", T.size_bucket(F.col("n_words"))).withColumn("position", place)


def pool(chunks: DataFrame, content_type: str | None, top: int) -> DataFrame:
    """At most top chunks, of a type if one is given: what a search service hands out as a page."""
    return (chunks if content_type is None else chunks.filter(F.col("content_type") == content_type)).limit(top)


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of two gradings (question, keep: null as true, score: null as 3): n, agreement_pct, mean_delta and n_disagreements."""
    side = lambda d, x: d.select("question", F.coalesce("keep", F.lit(True)).alias(f"k{x}"), F.coalesce("score", F.lit(3)).alias(f"s{x}"))
    out = side(a, 1).join(side(b, 2), "question").agg(F.count("*").alias("n"), F.count_if(F.col("k1") == F.col("k2")).alias("same"), F.avg(F.abs(F.col("s1") - F.col("s2"))).alias("d"))
    pct = F.round(F.col("same") / F.greatest(F.lit(1), F.col("n")) * 100, 1)
    return out.select("n", pct.alias("agreement_pct"), F.round(F.coalesce("d", F.lit(0.0)), 2).alias("mean_delta"), (F.col("n") - F.col("same")).alias("n_disagreements"))


def price(model: Column, prices=PRICES, default: tuple[float, float] = (2.0, 8.0)) -> Column:
    """Struct (input, output): prices a million tokens of the first name that the model's contains."""
    low = F.lower(model)
    pair = lambda i, o: F.struct(F.lit(i).alias("input"), F.lit(o).alias("output"))
    out = pair(*default)
    for name, i, o in reversed(prices):
        out = F.when(low.contains(name), pair(i, o)).otherwise(out)
    return out


def resolved_price(model: Column, prices, default: tuple[float, float]) -> Column:
    """Struct (input, output) of the model's name if it is listed, else of the first name that contains it or that it contains, else the default."""
    key = T.strip(F.lower(model))
    pair = lambda i, o: F.struct(F.lit(i).alias("input"), F.lit(o).alias("output"))
    out = pair(*default)
    for name, i, o in reversed(prices):
        out = F.when(key.contains(name) | F.lit(name).contains(key), pair(i, o)).otherwise(out)
    for name, i, o in prices:
        out = F.when(key == name, pair(i, o)).otherwise(out)
    return out


def token_usage(calls: DataFrame) -> DataFrame:
    """model, n_requests, input_tokens, output_tokens, total_tokens and cost of calls (model, input_tokens, output_tokens)."""
    out = calls.groupBy("model").agg(F.count("*").alias("n_requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    p = price(F.col("model"))
    cost = F.col("input_tokens") / 1_000_000 * p["input"] + F.col("output_tokens") / 1_000_000 * p["output"]
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).withColumn("cost", cost)


def token_totals(usage: DataFrame) -> DataFrame:
    """One row of token_usage()'s result."""
    return usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_requests", "input_tokens", "output_tokens", "total_tokens", "cost")])


def cost_estimate(calls: DataFrame, n_sample: int, n_all: int) -> DataFrame:
    """model, sample_tokens, sample_cost and full_cost: the cost of calls of a sample, and of all by proportion. Prices a million tokens."""
    usage = token_usage(calls)
    return usage.select("model", F.col("total_tokens").alias("sample_tokens"), F.round("cost", 4).alias("sample_cost"), F.round(F.col("cost") * (n_all / max(1, n_sample)), 2).alias("full_cost"))


def scored(rows: DataFrame, question: str, content: str) -> DataFrame:
    """rows with score, and whether they would be kept."""
    s = question_score(F.col(question), F.col(content))
    return rows.withColumn("score", s).withColumn("kept", s > 0)


def generated(chunks: DataFrame, ask, fields: list[str], schema: str) -> DataFrame:
    """chunks with the columns of schema that ask(a chunk's fields) returns as a dict: a hook for a model, asked in Arrow batches. A chunk for which it
    fails keeps nulls."""

    @F.pandas_udf(f"struct<{schema}>")
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names = [p.split(":")[0].split()[0].strip() for p in schema.split(",")]
        out = []
        for r in rows.to_dict("records"):
            try:
                out.append(ask(r) or {})
            except Exception:  # one chunk's failure must not end the run
                out.append({})
        return pd.DataFrame([{n: o.get(n) for n in names} for o in out], columns=names)

    return chunks.withColumn("_g", run(F.struct(*fields))).select("*", "_g.*").drop("_g")
