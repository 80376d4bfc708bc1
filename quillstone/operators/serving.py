"""Answering a batch of questions: search, promotion, cache, routing, prompts and what becomes of an answer.

A question is a row. Every step adds columns; `outcome` is the first reason to stop, and later steps leave rows with one alone. What models and
services say (intent, embeddings, answers, moderation) comes as columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import rules as R
from ..functions import text as T
from ..storage import materialise
from .search import nearest

#: Places of a result, how many are searched for each, answers put first and by what factor, and the least best scores.
TOP, WIDER, ANSWERS, ANSWER_FACTOR, LEAST_ANSWER = 5, 3, 2, 10, 0.7
LEAST_SEMANTIC, LEAST_PLAIN = 0.5, 0.01
TITLE_RATIO, TITLE_BOOST = 0.70, 2.0
CACHE_LEAST, HISTORY, PROMPT_HISTORY, ANSWER_WORDS = 0.90, 10, 6, 400
COMPLEX = (
    "difference between", "compare", "versus", " vs ", "what happens if", "what would", "if i ", "when i ", "and also", "as well as",
    "both", "all types", "better", "should i", "which is best", "which is better", "how does", "why does", "why would",
)


def fused(ranked: list[DataFrame], top: int = 10, k: int = 60) -> DataFrame:
    """query_id, rank, doc_id and score of several rankings (query_id, rank, doc_id) by reciprocal ranks."""
    every = ranked[0].select("query_id", "doc_id", "rank")
    for r in ranked[1:]:
        every = every.unionByName(r.select("query_id", "doc_id", "rank"))
    scores = every.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 10).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("query_id", "rank", "doc_id", "score")


def weighted(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """query_id, doc_id and score of lexical scores (query_id, doc_id, field, score) of fields, by weight of the field; others weigh 1."""
    names = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return found.groupBy("query_id", "doc_id").agg(F.sum(F.col("score") * F.coalesce(F.try_element_at(names, F.col("field")), F.lit(1.0))).alias("score"))


def reranked(found: DataFrame, scores: DataFrame, top: int = 10) -> DataFrame:
    """A ranking (query_id, rank, doc_id) in the order of a reranker's scores (query_id, doc_id, rerank); what it hasn't scored comes after."""
    both = found.join(scores, ["query_id", "doc_id"], "left")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "rank", "doc_id")
    return both.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).select("query_id", F.col("_r").alias("rank"), "doc_id", "rerank")


def url_hits(chunks: DataFrame, fragment: str, top: int = 20) -> DataFrame:
    """At most top chunks whose url contains a fragment: a look into the index."""
    return chunks.filter(F.col("source_url").contains(fragment)).limit(top)


def diagnosis(modes: dict[str, DataFrame], indexed: DataFrame, expected: DataFrame, top: int = TOP) -> DataFrame:
    """query_id and cause for expected (query_id, url): rankings of hybrid, vector, lexical and semantic search (query_id, rank, url), the last the one
    that counts, and indexed (url)."""
    out = expected.join(indexed.select("url", F.lit(True).alias("there")).distinct(), "url", "left")
    for name, found in modes.items():
        ranks = found.groupBy("query_id", "url").agg(F.min("rank").alias(f"{name}_rank"))
        out = out.join(ranks, ["query_id", "url"], "left")
    has = lambda m: F.col(f"{m}_rank").isNotNull()
    cause = F.when(F.col("there").isNull(), "not indexed").when(has("semantic"), "healthy").when(has("hybrid") & (F.col("hybrid_rank") <= top), "retrieved")
    cause = cause.when(has("hybrid"), "ranked too low").when(has("vector"), "words hurt").when(has("lexical"), "vector hurts").otherwise("absent everywhere")
    return out.select("query_id", "url", *[f"{m}_rank" for m in modes], cause.alias("cause"))


def uses_semantic(q: dict[str, Column]) -> Column:
    """Whether the costly reranker runs, by the first rule that fits. q: query, disclaimer, bereavement, confidence (null as 1), n_history, kind."""
    confidence, low = F.coalesce(q["confidence"], F.lit(1.0)), F.lower(q["query"])
    short = (T.n_words(q["query"]) <= 8) & (F.coalesce(q["kind"], F.lit("SPECIFIC")) == "SPECIFIC")
    always = q["disclaimer"] | q["bereavement"] | (confidence == 0.0) | (q["n_history"] > 0) | T.has_any(low, COMPLEX) | (confidence < 0.85)
    return F.when(always, F.lit(True)).when(short, F.lit(False)).otherwise(F.lit(True))


def retrieve(found: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The chunks that answer each of queries (query_id, semantic, kind, query): query_id, place, chunk_id, url, title, score and is_answer.

    found: (query_id, pos, chunk_id, url, parent_url, title, score, rerank, answer_score: of a passage that the service took as an answer, or null).
    Answers of LEAST_ANSWER or more come first, two at most, their scores times ten; their urls, and repeated ones, count once. The rest counts only
    if its best score reaches the least for semantic or plain search; for a broad question it is reordered by titles."""
    rows = found.withColumn("url", F.coalesce(F.nullif(F.col("parent_url"), F.lit("")), "url")).withColumn("score", F.coalesce(F.nullif(F.col("rerank"), F.lit(0.0)), "score", F.lit(0.0)))
    rows = rows.join(queries.select("query_id", "semantic", "kind", "query"), "query_id")
    is_answer = F.col("semantic") & (F.coalesce("answer_score", F.lit(0.0)) >= LEAST_ANSWER)
    answered = rows.filter(is_answer).groupBy("query_id").agg(F.collect_set("url").alias("_taken"))  # a few of a result
    w = Window.partitionBy("query_id")
    answers = rows.filter(is_answer).withColumn("n", F.row_number().over(w.orderBy("pos"))).filter(F.col("n") <= ANSWERS)
    answers = answers.select("query_id", "n", "chunk_id", "url", "title", (F.col("answer_score") * ANSWER_FACTOR).alias("score"), F.lit(True).alias("is_answer"))
    rest = rows.join(answered, "query_id", "left").filter(F.col("_taken").isNull() | ~F.array_contains(F.coalesce("_taken", F.array().cast("array<string>")), F.col("url")))
    rest = rest.withColumn("_u", F.row_number().over(Window.partitionBy("query_id", "url").orderBy("pos"))).filter("_u = 1")
    rest = rest.withColumn("_c", F.row_number().over(w.orderBy("pos"))).filter(F.col("_c") <= top * WIDER)
    least = F.when(F.col("semantic"), LEAST_SEMANTIC).otherwise(LEAST_PLAIN)
    rest = rest.withColumn("_best", F.max("score").over(w)).filter(F.col("_best") >= least).filter(F.col("_c") <= top)
    ratio = F.when((F.col("kind") == "BROAD") & (F.coalesce("title", F.lit("")) != ""), T.partial_similarity(F.col("query"), F.col("title"))).otherwise(0.0)
    boosted = rest.withColumn("_r", ratio).withColumn("_s", F.col("score") + F.when(F.col("_r") > TITLE_RATIO, F.col("_r") * TITLE_BOOST).otherwise(0.0))
    order = F.when(F.col("kind") == "BROAD", -F.col("_s")).otherwise(F.col("_c").cast("double"))
    rest = boosted.withColumn("n", F.row_number().over(w.orderBy(order, "_c")) + ANSWERS).select("query_id", "n", "chunk_id", "url", "title", "score", F.lit(False).alias("is_answer"))
    both = answers.unionByName(rest).withColumn("_k", F.count_if("is_answer").over(w))
    room = F.greatest(F.lit(1), F.lit(top) - F.col("_k"))
    both = both.filter(F.col("is_answer") | (F.col("n") - ANSWERS <= room))
    return both.withColumn("place", F.row_number().over(w.orderBy("n"))).drop("n", "_k")


#: Entries of a cache up to which each worker holds them.
HELD = 50_000


def nearest_cached(queries: DataFrame, cache: DataFrame, least: float = CACHE_LEAST, now: Column | None = None, ttl: float | None = None, held: int = HELD) -> DataFrame:
    """query_id, key and similarity of the cached answer (key, embedding, at) nearest to each of queries (query_id, embedding), if it is near enough. Of
    equals the least key counts. Entries older than ttl seconds don't count. A cache of at most `held` entries is held by each worker; blocks of a larger
    one meet blocks of queries."""
    if ttl is not None:
        cache = cache.filter(F.unix_micros("at") >= F.unix_micros(now) - int(ttl * 1_000_000))
    if cache.select("key").limit(held + 1).count() > held:
        return _nearest_in_blocks(queries, cache, least)
    rows = sorted((r.key, list(r.embedding)) for r in cache.select("key", "embedding").collect())
    shared = queries.sparkSession.sparkContext.broadcast(rows)
    kind = queries.schema["query_id"].dataType.simpleString()
    key_kind, key_type = cache.schema["key"].dataType.simpleString(), to_arrow_type(cache.schema["key"].dataType)

    def unit(m):
        n = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def run(batches):
        keys = [k for k, _ in shared.value]
        held = unit(np.array([v for _, v in shared.value], np.float64)) if keys else None
        for batch in batches:
            if held is None or not batch.num_rows:
                continue
            q = unit(np.array(batch.column(1).to_pylist(), np.float64))
            s = q @ held.T
            best = s.argmax(axis=1)
            cols = [batch.column(0), pa.array([keys[i] for i in best], key_type), pa.array(s[np.arange(len(best)), best])]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "key", "similarity"])

    got = queries.select("query_id", "embedding").mapInArrow(run, f"query_id {kind}, key {key_kind}, similarity double")
    return got.filter(F.col("similarity") >= least)


def _nearest_in_blocks(queries: DataFrame, cache: DataFrame, least: float) -> DataFrame:
    """The same by search.nearest(), over numbers in the place of keys: those of the cache in the order of its keys, those of queries below zero."""
    order = cache.select("key", "embedding").repartitionByRange("key").sortWithinPartitions("key")
    entries = materialise(order.withColumn("vec_id", F.monotonically_increasing_id()), "entries")
    asked = materialise(queries.select("query_id", F.col("embedding").alias("query")).withColumn("_q", -1 - F.monotonically_increasing_id()), "asked")
    found = nearest(entries.select("vec_id", "embedding"), asked.select(F.col("_q").alias("query_id"), "query"), 1)
    named = found.select(F.col("query_id").alias("_q"), "vec_id", "score").join(entries.select("vec_id", "key"), "vec_id").join(asked.select("_q", "query_id"), "_q")
    return named.filter(F.col("score") >= least).select("query_id", "key", F.col("score").alias("similarity"))


def cached_writes(cache: DataFrame, writes: DataFrame, capacity: int) -> DataFrame:
    """The cache (key, at, ...) after writes: of a key the last, and of all the newest, as many as there is room for."""
    both = cache.unionByName(writes)
    last = both.groupBy("key").agg(F.max_by(F.struct(*both.columns), "at").alias("r")).select("r.*")
    return last.orderBy(F.desc("at"), "key").limit(capacity)


def may_cache() -> Column:
    """Whether an answer is kept: not a refusal, a hit, what moved the model to empathy or came from the conversation, or what has no answer."""
    flags = [F.coalesce(F.col(c), F.lit(False)) for c in ("refused", "cache_hit", "needs_empathy", "follows_up")]
    out = F.coalesce("answer", F.lit("")) != ""
    for f in flags:
        out = out & ~f
    return out


def last_user(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with last_user: what the user said last before; null if nothing."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("role") == "user", F.col("text"))
    return turns.withColumn("last_user", F.last(said, ignorenulls=True).over(w)).withColumn("n_history", F.count("*").over(w))


def with_request_ids(queries: DataFrame, column: str = "request_id") -> DataFrame:
    """queries with an id for each that has none."""
    own = F.nullif(F.col(column), F.lit("")) if column in queries.columns else F.lit(None).cast("string")
    return queries.withColumn(column, F.coalesce(own, F.uuid()))


def supervised(queries: DataFrame, most_words: int = 100) -> DataFrame:
    """queries (query, last_user, n_history) cleaned and expanded, with outcome (empty, too long, ACCOUNT_LOOKUP, GREETING, FAREWELL, THANKS or null) and
    the flags needs_empathy, needs_disclaimer, bereavement and recommendation."""
    out = queries.withColumn("query", T.sanitized(F.col("query")))
    problem = R.length_problem(F.col("query"), most_words)
    out = out.withColumn("outcome", F.coalesce(problem, F.when(R.is_account_lookup(F.col("query")), "ACCOUNT_LOOKUP"), R.quick_intent(F.col("query"))))
    out = out.withColumn("n_history", F.least(F.col("n_history"), F.lit(HISTORY)))
    longer = R.expanded(F.col("query"), F.when(F.col("n_history") > 0, F.col("last_user")))
    out = out.withColumn("query", F.when(F.col("outcome").isNull(), longer).otherwise(F.col("query")))
    go = F.col("outcome").isNull()
    flags = {"needs_empathy": R.needs_empathy, "needs_disclaimer": R.needs_disclaimer, "bereavement": R.is_bereavement, "recommendation": R.is_recommendation}
    return out.withColumns({n: go & f(F.col("query")) for n, f in flags.items()})


def guarded(queries: DataFrame) -> DataFrame:
    """queries with the reason (pii, irrelevant, harmful) of an unsafe one as outcome; columns named, shield and severities are used if there."""
    has = lambda c: F.col(c) if c in queries.columns else None
    severities = [F.col(f"severities.{f.name}") for f in queries.schema["severities"].dataType.fields] if "severities" in queries.columns else None
    reason = R.input_problem(F.col("query"), has("named"), has("shield"), severities)
    return queries.withColumn("outcome", F.coalesce("outcome", reason))


def classified(queries: DataFrame, own: str = "INSURANCE", sure: float = 0.85) -> DataFrame:
    """queries (intent: null if the classifier failed, confidence) with intent, follows_up (why), kind and outcome: the intent itself, if it isn't our
    own, the classifier is sure and the query doesn't go on from the conversation."""
    failed = F.col("intent").isNull()
    why = F.when(~failed & (F.col("intent") != own), R.follow_up(F.col("query"), F.col("n_history")))
    out = queries.withColumn("follows_up", F.when(F.col("outcome").isNull(), why))
    other = ~failed & (F.col("intent") != own) & F.col("follows_up").isNull()
    out = out.withColumn("outcome", F.coalesce("outcome", F.when(other & (F.col("confidence") >= sure), F.col("intent"))))
    out = out.withColumn("confidence", F.when(failed, F.lit(0.0)).otherwise(F.col("confidence")))
    out = out.withColumn("intent", F.when(failed | F.col("follows_up").isNotNull(), F.lit(own)).otherwise(F.col("intent")))
    return out.withColumn("kind", F.when(failed, "SPECIFIC").otherwise(R.query_type(F.col("query"))))


def looked_up(queries: DataFrame, cache: DataFrame, least: float = CACHE_LEAST) -> DataFrame:
    """queries (query_id, embedding, canonical_embedding: null if there is none) with cached (key) and outcome CACHE of those that a cached answer fits,
    by their own words or, failing that, by the canonical form. What calls for empathy or is a recommendation isn't looked up; what goes on from a
    conversation only by its own words."""
    go = F.col("outcome").isNull() & ~F.col("needs_empathy") & ~F.col("recommendation")
    first = nearest_cached(queries.filter(go), cache, least).select("query_id", F.col("key").alias("_a"))
    second = queries.filter(go & F.col("follows_up").isNull() & F.col("canonical_embedding").isNotNull())
    second = nearest_cached(second.select("query_id", F.col("canonical_embedding").alias("embedding")), cache, least).select("query_id", F.col("key").alias("_b"))
    out = queries.join(first, "query_id", "left").join(second, "query_id", "left").withColumn("cached", F.coalesce("_a", "_b")).drop("_a", "_b")
    return out.withColumn("outcome", F.coalesce("outcome", F.when(F.col("cached").isNotNull(), "CACHE")))


def context(chunks: Column) -> Column:
    """The numbered sources of a prompt. chunks: array of struct (title, section, url, content)."""
    label = lambda c: F.coalesce(F.nullif(c["title"], F.lit("")), c["section"], F.lit(""))
    part = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Source: "), label(c), F.lit(" ("), c["url"], F.lit(")\n"), c["content"])
    return F.array_join(F.transform(chunks, part), "\n\n---\n\n")


def history_block(turns: Column, most: int = PROMPT_HISTORY) -> Column:
    """The last turns (array of struct: role, content) as a prompt shows them; "" without any."""
    n = F.size(turns)
    recent = F.slice(turns, F.greatest(F.lit(1), n - most + 1), F.lit(most))
    shown = F.transform(recent, lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), t["content"]))
    return F.when(n > 0, F.concat(F.lit("Previous conversation:\n"), F.array_join(shown, "\n"), F.lit("\n\n"))).otherwise("")


def prompt(query: Column, turns: Column, chunks: Column, notes: list[tuple[Column, str]], closing: str, follow_up: Column | None = None, follow_closing: str = "") -> Column:
    """History, the notes whose condition holds, context, question and closing, as a model is asked; a query that goes on from the conversation and
    has no sources gets no context."""
    said = F.concat(history_block(turns), *[F.when(c, F.lit(n + "\n\n")).otherwise("") for c, n in notes])
    asked = F.concat(F.lit("Customer question: "), query, F.lit("\n\n"))
    whole = F.concat(said, F.lit("Context:\n\n"), context(chunks), F.lit("\n\n"), asked, F.lit(closing))
    alone = F.concat(said, asked, F.lit(follow_closing))
    return whole if follow_up is None else F.when(F.coalesce(follow_up, F.lit(False)) & (F.size(chunks) == 0), alone).otherwise(whole)


def finalised(answer: Column, urls: Column, fixed: list[tuple[str, str, list[str]]], extras: list[tuple[Column, list[str]]]) -> Column:
    """Struct (text, refused, cited) of a model's answer. urls: those of its sources. fixed: (text, name, links) of answers that are refusals: one that
    contains it is that text alone, with those links. Else it is cleaned, marks are numbered anew, and the links of the first of extras (condition,
    links) that holds are cited after the sources, each once."""
    made = T.citations_renumbered(T.clean_answer(answer), urls)
    own = F.transform(made["cited"], lambda n: F.element_at(urls, n))
    more = F.array().cast("array<string>")
    for cond, links in reversed(extras):
        more = F.when(cond, F.array(*[F.lit(x) for x in links])).otherwise(more)
    out = F.struct(made["text"].alias("text"), F.lit(None).cast("string").alias("refused"), F.array_union(own, more).alias("cited"))
    for said, name, links in reversed(fixed):
        alone = F.struct(F.lit(said).alias("text"), F.lit(name).alias("refused"), F.array(*[F.lit(x) for x in links]).alias("cited"))
        out = F.when(made["text"].contains(said), alone).otherwise(out)
    return out


def shortened(text: Column, most: int = ANSWER_WORDS) -> Column:
    """The first words of what has more than most, with dots."""
    words = F.filter(F.split(T.collapsed(text), " "), lambda w: w != "")
    return F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("..."))).otherwise(text)


def output_reason(severities: list[Column]) -> Column:
    """unsafe_output for an answer that moderation rates as severe; null if it is fine."""
    return F.when(R.is_severe(severities), "unsafe_output")


#: The refusal that each reason leads to.
REASONS = {"pii": "pii_detected", "irrelevant": "irrelevant", "harmful": "harmful", "unsafe_output": "unsafe_output"}


def with_refusals(queries: DataFrame, templates: dict[str, str]) -> DataFrame:
    """queries with answer: the refusal of those whose outcome is a reason for one."""
    names = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    reason = F.try_element_at(names, F.col("outcome"))
    return queries.withColumn("answer", F.when(reason.isNotNull(), R.refusal(reason, templates)).otherwise(F.col("answer") if "answer" in queries.columns else F.lit(None).cast("string")))


#: Codes and errors that are worth another try.
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)


def is_transient(error: BaseException) -> bool:
    """Whether a call may succeed if it is made again: the network, a time-out, throttling or a server's failure."""
    return isinstance(error, (TimeoutError, ConnectionError)) or getattr(error, "status_code", None) in TRANSIENT


def retrying(fn, attempts: int = 4, base: float = 2.0, longest: float = 60.0):
    """fn, called again after a transient error, each time after twice as long, give or take a quarter: for the hooks below, whose calls go out from
    tasks. What remains an error is left to Spark, which runs the task again."""
    import random
    import time

    def run(*args, **how):
        for i in range(attempts):
            try:
                return fn(*args, **how)
            except Exception as e:
                if i + 1 == attempts or not is_transient(e):
                    raise
                time.sleep(min(longest, base * 2**i) * random.uniform(0.75, 1.25))

    return run


def answered(rows: DataFrame, ask, question: str, schema: str = "answer string, error string, latency_seconds double") -> DataFrame:
    """rows with what ask(question) returns, a text or a dict: a hook. An error is a value, and every call is timed."""
    import time

    @F.pandas_udf(f"struct<{schema.replace(' string', ':string').replace(' double', ':double')}>")
    def run(q: pd.Series) -> pd.DataFrame:
        out = []
        for x in q:
            began, got = time.perf_counter(), {}
            try:
                said = ask(x)
                got = said if isinstance(said, dict) else {"answer": said}
            except Exception as e:  # one question's failure must not end the run
                got = {"error": repr(e)}
            out.append((got.get("answer"), got.get("error"), time.perf_counter() - began))
        return pd.DataFrame(out, columns=["answer", "error", "latency_seconds"])

    return rows.withColumn("_a", run(question)).select("*", "_a.*").drop("_a")


def embedded(rows: DataFrame, text: str, embed, n: int, batch: int = 50) -> DataFrame:
    """rows with embedding: embed(list of texts) asked by batches of at most that many, in order; an answer of the wrong number or length is an error."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), batch):
            part = texts.iloc[i : i + batch].tolist()
            got = embed(part)
            if len(got) != len(part) or any(len(v) != n for v in got):
                raise ValueError(f"{len(got)} embeddings for {len(part)} texts, or not of {n} numbers")
            out += got
        return pd.Series(out)

    return rows.withColumn("embedding", run(text))


def retrieval_check(found: DataFrame, expected: DataFrame, top: int = 10) -> DataFrame:
    """One row: n, hits and verdict (passed with all, partial from 80 %, else failed) of expected (query_id, fragment) in the first places of found
    (query_id, rank, url)."""
    near = found.filter(F.col("rank") <= top).join(expected, "query_id").filter(F.col("url").contains(F.col("fragment"))).select("query_id").distinct()
    out = expected.join(near.withColumn("_hit", F.lit(1)), "query_id", "left").agg(F.count("*").alias("n"), F.count("_hit").alias("hits"))
    return out.withColumn("verdict", F.when(F.col("hits") == F.col("n"), "passed").when(F.col("hits") >= 0.8 * F.col("n"), "partial").otherwise("failed"))


def run_batch(queries: DataFrame, cache: DataFrame, templates: dict[str, str], most_words: int = 100) -> DataFrame:
    """The batch up to retrieval: every query with its outcome, flags, route and, where it is refused, its answer. Columns as the steps want them."""
    asked = materialise(classified(guarded(supervised(queries, most_words))), "batch")  # read three times by what follows
    out = looked_up(asked, cache)
    q = {"query": F.col("query"), "disclaimer": F.col("needs_disclaimer"), "bereavement": F.col("bereavement"), "confidence": F.col("confidence"), "n_history": F.col("n_history"), "kind": F.col("kind")}
    out = out.withColumn("semantic", uses_semantic(q)).withColumn("simple", R.is_simple(F.col("query"), F.col("needs_empathy"), F.col("kind")))
    return with_refusals(out, templates)
