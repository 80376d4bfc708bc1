"""Queries over conversations and events: routing, safety, prompts, answers, costs, reports, limits and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import evaluation, questions, review, serving
from ..streaming import jobs
from .base import COLLAPSED, STRIPPED, TOKENS, read

#: Phrases that occur in the tables, in place of a company's own.
WORDS = {"broad": ("ion", "ent"), "personal": ("zz", "öß"), "empathy": ("mort", "tion t", "dre"), "decision": ("sho", "tra")}


def _users(spark, sf_dir):
    return read(spark, sf_dir, "conversations").filter("role = 'user'")


def conversation_history(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.sum(F.length("text")).alias("n_chars"))


def clean_history(spark, sf_dir):
    return review.clean_history(read(spark, sf_dir, "conversations"), F.length("text") < 120).select("conv_id", "turn", "role")


def last_user(spark, sf_dir):
    """What the user said last before each turn."""
    out = serving.last_user(read(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", F.md5(F.coalesce("last_user", F.lit(""))).alias("last_md5"), "n_history")


def trigger_flags(spark, sf_dir):
    """Flags and route of every user turn, by the lists as they are and by words that occur."""
    q = F.col("text")
    own = {
        "empathy": R.needs_empathy(q, WORDS["empathy"]),
        "disclaimer": R.needs_disclaimer(q, WORDS["decision"]),
        "bereavement": R.is_bereavement(q),
        "recommendation": R.is_recommendation(q),
        "lookup": R.is_account_lookup(q),
        "kind": R.query_type(q, WORDS["broad"], WORDS["personal"]),
        "follows_up": R.follow_up(q, F.col("turn")),
        "intent": R.quick_intent(q),
        "problem": R.length_problem(q, 30),
    }
    return _users(spark, sf_dir).select("conv_id", "turn", *[c.alias(n) for n, c in own.items()])


def model_route(spark, sf_dir):
    q = F.col("text")
    return _users(spark, sf_dir).select("conv_id", "turn", R.is_simple(q, F.col("turn") % 5 == 4, R.query_type(q, WORDS["broad"], WORDS["personal"])).alias("simple"))


def pii_types(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(R.personal_data(F.col("text")), ",").alias("kinds"), R.blocks_personal(F.col("text")).alias("blocks"))


def pii_mask(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(R.masked(F.col("text"))).alias("masked_md5"))


def input_problems(spark, sf_dir):
    """The first check that every document, as a question, fails."""
    shield = F.when(F.col("doc_id") % 17 == 3, False).when(F.col("doc_id") % 17 == 4, True)
    severity = F.when(F.col("doc_id") % 19 == 5, 4).otherwise(0)
    return read(spark, sf_dir, "documents").select("doc_id", R.input_problem(F.col("text"), None, shield, [severity]).alias("problem"))


def query_forms(spark, sf_dir):
    """The standard terms of every user turn."""
    made = R.with_synonyms(F.concat(F.lit("My pension pot calls: recall the Telephone call call "), F.coalesce("text", F.lit(""))))
    return _users(spark, sf_dir).select("conv_id", "turn", F.md5(made).alias("terms_md5"), F.md5(R.normal_query(F.col("text"))).alias("normal_md5"))


def answer_scores(spark, sf_dir):
    """Every assistant turn as an answer, the next as the expected one."""
    t = read(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    both = t.join(t.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("answer").alias("expected")), ["conv_id", "turn"])
    clean = T.without_citations(F.col("answer"))
    refused = T.refused(F.when(F.col("turn") == 1, F.lit(True)), F.col("answer"))
    cost = evaluation.cost(F.when(F.col("turn") == 3, F.lit(0.5)), F.length("expected"), F.length("answer"), (0.002, 0.008))
    return both.select("conv_id", "turn", F.round(T.token_f1(F.col("expected"), clean), 4).alias("token_f1"), refused.alias("refused"), cost.alias("cost"))


def run_report(spark, sf_dir):
    """The report of all answers, of which each is the first half of what was expected. The mean of the likeness by characters is no SQL's, and is tested apart."""
    t = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    none, half = F.lit(None), F.expr("substring(text, 1, int(ceil(length(text) / 2)))")
    cases = t.select(
        F.col("text").alias("expected"), half.alias("answer"), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("citations"), F.array(F.lit("A ")).alias("relevant"),
        none.cast("boolean").alias("refused"), none.cast("double").alias("cost_usd"), F.length("text").alias("input_tokens"), F.lit(10).alias("output_tokens"),
        F.when(F.col("conv_id") % 11 == 0, "e").alias("error"), (F.col("turn") + F.col("conv_id") % 7).cast("double").alias("latency_seconds"),
    )
    return evaluation.run_report(evaluation.score_answers(cases, 5, (0.002, 0.008))).drop("avg_sequence_similarity")


def token_cost(spark, sf_dir):
    """Tokens and cost by model; a turn's length stands for its tokens."""
    model = F.element_at(F.array(*[F.lit(m) for m in ("gpt-5-mini-x", "GPT-4o", "other", "gpt-4o-mini")]), (F.col("conv_id") % 4 + 1).cast("int"))
    calls = read(spark, sf_dir, "conversations").select(model.alias("model"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return questions.token_usage(calls).withColumn("cost", F.round("cost", 8))


def cost_estimate(spark, sf_dir):
    calls = read(spark, sf_dir, "conversations").select(F.lit("gpt-4o").alias("model"), F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return questions.cost_estimate(calls, 100, 6827)


def grader_agreement(spark, sf_dir):
    a = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("question"), (F.col("quality") == 1).alias("keep"), F.when(F.col("doc_id") % 5 != 0, F.col("quality") + 2).alias("score"))
    b = read(spark, sf_dir, "labels").filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("question"), F.when(F.col("doc_id") % 4 != 0, F.col("toxic") == 0).alias("keep"), (F.col("toxic") + 3).alias("score"))
    return questions.agreement(a, b)


def _metrics(spark, sf_dir, side: int):
    cents = F.round(F.col("value") * 100).cast("long")
    rows = read(spark, sf_dir, "events").filter(F.col("user_id") % 2 == side).withColumn("cents", cents)
    return rows.groupBy(F.concat("event_type", F.lit("_value")).alias("metric")).agg((F.sum("cents") / F.count("cents")).alias("value"))


def baseline_report(spark, sf_dir):
    out = evaluation.against_baseline(_metrics(spark, sf_dir, 0), _metrics(spark, sf_dir, 1), lower_is_better=("error_value",))
    return out.select("metric", F.round("delta", 4).alias("delta"), "verdict")


def report_metrics(spark, sf_dir):
    """A report's numbers by dotted names."""
    e = read(spark, sf_dir, "events")
    report = e.agg(F.struct(F.count("*").alias("n"), F.struct(F.max("value").alias("most")).alias("values")).alias("events"), F.lit("text").alias("note"))
    return evaluation.flattened(report)


def event_percentiles(spark, sf_dir):
    """Percentiles by nearest rank for each type, and by rounded rank of all."""
    rows = read(spark, sf_dir, "events")
    own = rows.groupBy("event_type").agg(evaluation.nearest_rank("value", 50).alias("p50"), evaluation.nearest_rank("value", 95).alias("p95"), F.max("value").alias("most"))
    every = rows.agg(F.lit("all").alias("event_type"), evaluation.nearest_rank("value", 50).alias("p50"), evaluation.rounded_rank(rows, "value").alias("p95"), F.max("value").alias("most"))
    return own.unionByName(every)


def similarity_report(spark, sf_dir):
    """Similarities of matches by category, and whether the threshold tells them apart."""
    kind = F.element_at(F.array(*[F.lit(c) for c in ("exact", "paraphrase", "near-miss", "unrelated")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(kind.alias("category"), F.when(F.col("event_id") % 7 != 0, F.col("value") / 20).alias("similarity"))
    out = evaluation.similarity_report(rows, 0.3)
    return out.select("category", "n", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), F.round("greatest", 6).alias("greatest"), "hits")


def separability(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(c) for c in ("exact", "paraphrase", "near-miss", "unrelated")]), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(kind.alias("category"), F.col("value").alias("similarity"))
    return evaluation.separability(rows, 5.0).withColumn("gap", F.round("gap", 6))


def rate_limit(spark, sf_dir):
    limits = ((3, 3600), (20, 86400))
    return review.limited(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", limits).select("event_id", "user_id", "accepted")


def event_windows(spark, sf_dir):
    return jobs.tumbling(_events(spark, sf_dir), "ts", "1 hour", "10 minutes", "event_type")


def event_slides(spark, sf_dir):
    return jobs.sliding(_events(spark, sf_dir), "ts", "2 hours", "1 hour", "10 minutes")


def event_sessions(spark, sf_dir):
    return jobs.sessions(_events(spark, sf_dir), "ts", "2 hours", "10 minutes", "user_id")


def _events(spark, sf_dir):
    """As local times: the session's time zone plays no part."""
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


NAMES = (
    conversation_history, clean_history, last_user, trigger_flags, model_route, pii_types, pii_mask, input_problems, query_forms, answer_scores, run_report,
    token_cost, cost_estimate, grader_agreement, baseline_report, report_metrics, event_percentiles, similarity_report, separability, rate_limit,
    event_windows, event_slides, event_sessions,
)
QUERIES = {f.__name__: f for f in NAMES}


def _any(column: str, phrases) -> str:
    listed = ", ".join("'" + p.replace("'", "''") + "'" for p in phrases)
    return f"len(list_filter([{listed}], lambda p: contains({column}, p))) > 0"


def _matches(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


_LOW = f"{STRIPPED.format('lower(text)')}"
_N = f"len(list_filter(string_split({COLLAPSED.format('text')}, ' '), lambda w: w <> ''))"
_KIND = f"CASE WHEN {_any(_LOW, WORDS['personal'])} THEN 'SPECIFIC' WHEN {_any(_LOW, WORDS['broad'])} THEN 'BROAD' ELSE 'SPECIFIC' END"
_BARE = STRIPPED.format(rf"regexp_replace({_LOW}, '[^\pL\pN_\s]', '', 'g')")
_W = R.W
_FOLLOWS = " ".join(f"WHEN {_any(_LOW, p)} THEN '{k}'" for p, k in ((_W.HISTORY_REFERENCE, "history_reference"), (_W.DISAGREEMENT, "disagreement"), (_W.CLARIFICATION, "clarification"), (_W.FRUSTRATED_FAREWELL, "frustrated_farewell"), (_W.CONTINUATION, "continuation")))
_HIT = [f"CASE WHEN regexp_matches(coalesce(text, ''), '(?i){p}') THEN '{k}' END" for k, p, _ in _W.PERSONAL_DATA]
_BLOCKS = "(" + " OR ".join(f"regexp_matches(coalesce(text, ''), '(?i){p}')" for k, p, _ in _W.PERSONAL_DATA if k in _W.BLOCKING) + ")"
_MASKED = "coalesce(text, '')"
for _, _p, _r in _W.PERSONAL_DATA:
    _MASKED = f"regexp_replace({_MASKED}, '(?i){_p}', '{_r}', 'g')"
_IRRELEVANT = f"(({_any('lower(text)', _W.IRRELEVANT)}) OR {_matches('lower(text)', _W.IRRELEVANT_PATTERNS)}) AND NOT ({_any('lower(text)', _W.for_brand(_W.RELEVANT))})"
_E = "WITH e AS (SELECT event_type || '_value' AS metric, user_id % 2 AS side, sum(round(value * 100)::BIGINT)::DOUBLE / count(value) AS v FROM events GROUP BY 1, 2)"
_CATEGORY = "['exact', 'paraphrase', 'near-miss', 'unrelated'][(event_id % 4 + 1)::INT]"
_PRICE = "CASE WHEN contains(lower(model), 'gpt-5-mini') THEN {0} WHEN contains(lower(model), 'gpt-4o-mini') THEN {1} WHEN contains(lower(model), 'gpt-4o') THEN {2} ELSE {3} END"
ORACLE_SQL = {
    "conversation_history": """
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, sum(length(text))::BIGINT AS n_chars FROM conversations GROUP BY conv_id""",
    "clean_history": """
WITH m AS (SELECT *, coalesce(role = 'assistant' AND length(text) < 120, false) AS bad FROM conversations),
n AS (SELECT *, coalesce(lead(bad) OVER (PARTITION BY conv_id ORDER BY turn), false) AS nxt FROM m) SELECT conv_id, turn, role FROM n WHERE NOT bad AND NOT (nxt AND role = 'user')""",
    "last_user": """
SELECT conv_id, turn, md5(coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w, '')) AS last_md5, count(*) OVER w AS n_history FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "trigger_flags": f"""
SELECT conv_id, turn, {_any('lower(text)', WORDS['empathy'])} AS empathy, {_any('lower(text)', WORDS['decision'])} AS disclaimer, {_any('lower(text)', _W.BEREAVEMENT)} AS bereavement,
  {_any('lower(text)', _W.for_brand(_W.RECOMMENDATION))} AS recommendation, {_any('lower(text)', _W.ACCOUNT_LOOKUP)} AS lookup, {_KIND} AS kind,
  CASE WHEN turn = 0 THEN NULL {_FOLLOWS} WHEN {_N} <= 6 AND {_any(_LOW, _W.IMPLICIT)} THEN 'implicit_short_query' END AS follows_up,
  CASE WHEN {_BARE} IN ({', '.join("'" + g.replace("'", "''") + "'" for g in _W.GREETINGS)}) THEN 'GREETING'
    WHEN {_BARE} IN ({', '.join("'" + g.replace("'", "''") + "'" for g in _W.FAREWELLS)}) THEN 'FAREWELL'
    WHEN {_BARE} IN ({', '.join("'" + g.replace("'", "''") + "'" for g in _W.THANKS)}) THEN 'THANKS' END AS intent,
  CASE WHEN {_LOW} = '' THEN 'empty' WHEN {_N} > 30 THEN 'too long' END AS problem FROM conversations WHERE role = 'user'""",
    "model_route": rf"""
WITH q AS (SELECT conv_id, turn, lower(text) AS low, {_N} AS n, len(regexp_extract_all(text, '\?')) AS marks, {_KIND} AS kind FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN turn % 5 = 4 OR {_any('low', _W.TECHNICAL)} OR {_any('low', ('compare', 'difference between', 'versus', ' vs ', 'calculate'))} OR n > 20 OR marks > 1 THEN false
  WHEN kind = 'BROAD' THEN true ELSE (n < 10)::INT + (marks = 1)::INT + ({_any('low', _W.SIMPLE)})::INT >= 2 END AS simple FROM q""",
    "pii_types": f"SELECT doc_id, concat_ws(',', {', '.join(_HIT)}) AS kinds, {_BLOCKS} AS blocks FROM documents",
    "pii_mask": f"SELECT doc_id, md5({_MASKED}) AS masked_md5 FROM documents",
    "input_problems": f"""
SELECT doc_id, CASE WHEN {STRIPPED.format("coalesce(text, '')")} = '' THEN 'irrelevant' WHEN {_BLOCKS} THEN 'pii' WHEN {_IRRELEVANT} THEN 'irrelevant'
  WHEN {_matches('text', _W.CRIME + _W.WEAPONS)} THEN 'harmful' WHEN doc_id % 17 = 3 THEN 'harmful'
  WHEN doc_id % 17 <> 4 AND {_matches('text', _W.INJECTION + _W.JAILBREAK)} THEN 'harmful' WHEN doc_id % 19 = 5 THEN 'harmful' END AS problem FROM documents""",
    "answer_scores": f"""
WITH t AS (SELECT conv_id, turn, text AS answer FROM conversations WHERE role = 'assistant'), b AS (SELECT a.*, e.answer AS expected FROM t a JOIN t e ON a.conv_id = e.conv_id AND e.turn = a.turn + 2),
s AS (SELECT *, list_distinct({TOKENS.format('expected')}) AS x, list_distinct({TOKENS.format(r"regexp_replace(coalesce(answer, ''), '\[[0-9]+\]', '', 'g')")}) AS y FROM b)
SELECT conv_id, turn, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) ELSE 0 END, 4)::DOUBLE AS token_f1,
  turn = 1 OR ({_any("lower(coalesce(answer, ''))", _W.REFUSALS)}) AS refused,
  round(CASE WHEN turn = 3 THEN 0.5::DOUBLE ELSE length(expected) / 1000 * 0.002::DOUBLE + length(answer) / 1000 * 0.008::DOUBLE END, 6) AS cost FROM s""",
    "run_report": f"""
WITH t AS (SELECT *, conv_id % 11 = 0 AS err, turn + conv_id % 7 AS s, left(text, ceil(length(text) / 2)::INT) AS answer FROM conversations WHERE role = 'assistant'),
n AS (SELECT count(*) AS n FROM t), o AS (SELECT s, row_number() OVER (ORDER BY s) AS r FROM t),
y AS (SELECT *, list_distinct({TOKENS.format('text')}) AS p, list_distinct({TOKENS.format('answer')}) AS q, round(length(text) / 1000 * 0.002::DOUBLE + 10 / 1000 * 0.008::DOUBLE, 6) AS c FROM t),
z AS (SELECT *, CASE WHEN len(p) > 0 AND len(q) > 0 THEN 2.0::DOUBLE * len(list_intersect(p, q)) / (len(p) + len(q)) ELSE 0 END AS f FROM y)
SELECT count(*) AS num_cases, count(*) FILTER (err) AS num_errors, round(avg(err::INT), 4) AS error_rate, round(avg(s), 4) AS mean_seconds,
  (SELECT s::DOUBLE FROM o, n WHERE r = round_even(0.95 * (n - 1), 0) + 1) AS p95_seconds, max(s)::DOUBLE AS max_seconds,
  round(avg(coalesce(NOT err AND {STRIPPED.format("coalesce(answer, '')")} <> '', false)::INT), 4) AS answered_rate,
  round(avg(({_any("lower(coalesce(answer, ''))", _W.REFUSALS)})::INT), 4) AS refusal_rate, count(length(text)) AS num_cases_with_cost,
  round(avg(CASE WHEN NOT err THEN f END), 4) AS avg_token_f1, round(sum(c), 6) AS total_cost_usd, round(avg(c), 4) AS avg_cost_usd,
  count(*) FILTER (conv_id % 3 = 0) AS num_cases_with_citations, CASE WHEN count(*) FILTER (conv_id % 3 = 0) > 0 THEN 1.0::DOUBLE END AS hit_rate,
  CASE WHEN count(*) FILTER (conv_id % 3 = 0) > 0 THEN 1.0::DOUBLE END AS mrr, CASE WHEN count(*) FILTER (conv_id % 3 = 0) > 0 THEN 0.5::DOUBLE END AS avg_precision,
  CASE WHEN count(*) FILTER (conv_id % 3 = 0) > 0 THEN 1.0::DOUBLE END AS avg_recall FROM z""",
    "token_cost": f"""
WITH c AS (SELECT ['gpt-5-mini-x', 'GPT-4o', 'other', 'gpt-4o-mini'][(conv_id % 4 + 1)::INT] AS model, length(text) AS i, turn AS o FROM conversations),
s AS (SELECT model, count(*) AS n_requests, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens FROM c GROUP BY 1)
SELECT *, input_tokens + output_tokens AS total_tokens, round(input_tokens / 1000000 * {_PRICE.format('1.25', '0.15', '2.5', '2.0')}::DOUBLE + output_tokens / 1000000 * {_PRICE.format('5.0', '0.6', '10.0', '8.0')}::DOUBLE, 8) AS cost FROM s""",
    "cost_estimate": """
WITH s AS (SELECT sum(length(text))::BIGINT AS i, sum(turn)::BIGINT AS o FROM conversations)
SELECT 'gpt-4o' AS model, i + o AS sample_tokens, round(i / 1000000 * 2.5::DOUBLE + o / 1000000 * 10.0::DOUBLE, 4) AS sample_cost,
  round((i / 1000000 * 2.5::DOUBLE + o / 1000000 * 10.0::DOUBLE) * 68.27::DOUBLE, 2) AS full_cost FROM s""",
    "grader_agreement": """
WITH p AS (SELECT quality = 1 AS ka, CASE WHEN doc_id % 5 <> 0 THEN quality + 2 ELSE 3 END AS sa, CASE WHEN doc_id % 4 <> 0 THEN toxic = 0 ELSE true END AS kb, toxic + 3 AS sb
  FROM labels WHERE doc_id % 3 <> 0)
SELECT count(*) AS n, round(count(*) FILTER (ka = kb) / greatest(1, count(*)) * 100, 1) AS agreement_pct, round(coalesce(avg(abs(sa - sb)), 0), 2) AS mean_delta,
  count(*) - count(*) FILTER (ka = kb) AS n_disagreements FROM p""",
    "baseline_report": f"""
{_E}, d AS (SELECT a.metric, (b.v - a.v) / abs(a.v) AS delta FROM e a JOIN e b ON a.metric = b.metric AND a.side = 0 AND b.side = 1)
SELECT metric, round(delta, 4) AS delta, CASE WHEN abs(delta) <= 0.03 THEN 'unchanged' WHEN (delta > 0) <> (metric = 'error_value') THEN 'improved' ELSE 'degraded' END AS verdict FROM d""",
    "report_metrics": "SELECT 'events.n' AS metric, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'events.values.most', max(value) FROM events",
    "event_percentiles": """
WITH n AS (SELECT count(*) AS n FROM events), o AS (SELECT value, row_number() OVER (ORDER BY value) AS r FROM events)
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1
UNION ALL SELECT 'all', quantile_disc(value, 0.5), (SELECT value FROM o, n WHERE r = round_even(0.95 * (n - 1), 0) + 1), max(value) FROM events""",
    "similarity_report": f"""
WITH r AS (SELECT {_CATEGORY} AS category, CASE WHEN event_id % 7 <> 0 THEN value / 20 END AS s FROM events)
SELECT category, count(*) AS n, round(min(s), 6) AS least, round(avg(s), 6) AS mean, round(max(s), 6) AS greatest, count(*) FILTER (s >= 0.3) AS hits FROM r GROUP BY 1""",
    "separability": f"""
WITH r AS (SELECT {_CATEGORY} AS c, value AS s FROM events), x AS (SELECT min(s) FILTER (c IN ('paraphrase', 'exact')) AS low, max(s) FILTER (c IN ('near-miss', 'unrelated')) AS high FROM r)
SELECT low, high, low > high AS separable, round(low - high, 6) AS gap, high < 5.0 AND 5.0 <= low AS inside FROM x""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_slides": """
SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1""",
    "event_sessions": """
WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l)
SELECT min(ts) AS started, max(ts) + INTERVAL 2 HOUR AS ended, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
}
