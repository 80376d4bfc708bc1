"""Streams: the limiter, counters and windows over events, the expiring cache, first-wins dedup, and jobs that files set off."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import urls as U
from ..operators import sync
from ..operators.blocks import chunk_pages
from ..sources.files import archive
from ..sources.snapshots import Pointer, Table
from ..storage import materialise

#: Most accepted requests of a key in as many seconds.
LIMITS = ((10, 60), (100, 3600))


def limited_stream(events: DataFrame, key: str, at: str, order: str, limits: tuple[tuple[int, int], ...] = LIMITS, late: str = "1 hour") -> DataFrame:
    """key, order, at and accepted of a stream of events, by the sliding log of each key: an event is accepted unless a window before it is full of
    accepted ones; rejected ones don't count. State: the times of a key's last accepted events, at most the greatest limit. A micro-batch is taken in
    order of time; one that comes later than a batch after it is judged by the log as it is. Null keys are one key.

    A timer of event time ends the state of a key once all its windows are over: when the events of any key are `late` beyond its last one and the
    longest window. Events that are later than that are not judged, and have no row."""
    stamped = events.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(order).cast("long").alias("event"), F.col(at).cast("timestamp").alias("_t"))
    keyed = stamped.withWatermark("_t", late).withColumn("at", F.unix_micros("_t"))
    most, longest = max(n for n, _ in limits), max(s for _, s in limits)

    def run(k, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event"])
        ok = []
        for t in rows["at"].tolist():
            good = all(len(log) < n or t - log[-n] >= s * 1_000_000 for n, s in limits)
            if good:
                log = [*log, t][-most:]
            ok.append(good)
        newest = int(rows["at"].max())
        state.update((([t for t in log if newest - t < longest * 1_000_000] or log[-1:]),))
        state.setTimeoutTimestamp(max(newest // 1000 + longest * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(ok), "event": rows["event"].tolist(), "at": rows["at"].tolist(), "accepted": ok})

    out = "key string, event bigint, at bigint, accepted boolean"
    return keyed.groupBy("key").applyInPandasWithState(run, out, "log array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def tumbling(events: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """window_start, by and n of each window of time, closed when events are `late` beyond it."""
    out = events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n")


def sliding(events: DataFrame, at: str, width: str, step: str, late: str, *by: str) -> DataFrame:
    out = events.withWatermark(at, late).groupBy(F.window(at, width, step), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n")


def sessions(events: DataFrame, at: str, gap: str, late: str, *by: str) -> DataFrame:
    """started, ended, by and n of runs of events without a gap as long."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), *by, "n")


def usage(calls: DataFrame) -> DataFrame:
    """model, n_requests, input_tokens and output_tokens so far: an update for each model of a micro-batch."""
    return calls.groupBy("model").agg(F.count("*").alias("n_requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def first_seen(rows: DataFrame, key: list[str], at: str, late: str) -> DataFrame:
    """The first row of each key; a key is forgotten when events are `late` beyond it."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def live(entries: DataFrame, at: str, now: Column, ttl: float) -> DataFrame:
    """Entries that are not older than ttl seconds."""
    return entries.filter(F.unix_micros(F.col(at).cast("timestamp")) >= F.unix_micros(now) - int(ttl * 1_000_000))


def on_files(stream: DataFrame, job: Callable[[DataFrame, int], None], checkpoint: str, name: str):
    """Starts job(rows, batch) for the files that have come since the last run, each once, and ends: what a trigger or a timer calls. A batch that fails is
    given again, so that job must write the same for the same batch."""
    writer = stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(availableNow=True).start()


def judged_output(rows: DataFrame, problems: DataFrame, good: str, rejected: str, blocking: bool = True) -> str:
    """Commits the pages of a run as the next version of where they belong: of `rejected` if problems (severity) hold an error and errors block, else
    of `good`. Returns which."""
    bad = blocking and problems.filter("severity = 'ERROR'").limit(1).count() > 0
    path = rejected if bad else good
    Table(rows.sparkSession, path, "json").write(rows)
    return path


# Jobs that keep an index in step ----------------------------------------------------------------------------------------------------

Batch = Callable[[DataFrame, int], None]


def _run(name: str, index: Table, runs: Pointer, plan: Callable[[DataFrame, DataFrame], dict], archived: str | None, key: str) -> Batch:
    """A job for on_files(). plan(batch, chunks of the current version) gives rows (to put in), stale (keys to take out), and refused (a reason, or
    None). What goes is archived by batch, the next version committed under the batch's name, and the outcome noted in runs; a refused batch
    leaves the index as it is, and is noted, too. A batch that comes again, after any failure in between, changes nothing that was done."""

    def job(batch: DataFrame, number: int) -> None:
        label = f"{name}-{number}"
        noted = runs.version()
        if any(e["value"]["batch"] == label for e in runs.history()):
            return
        outcome, version = None, index.of_batch(label)
        if version is None:
            batch = batch.persist()
            try:
                now = index.read()
                made = plan(batch, now)
                outcome = made["refused"]
                if outcome is None:
                    if archived is not None:
                        archive(now.join(made["stale"], key, "left_semi"), archived, label)
                    version = sync.apply_plan(index, made["rows"], made["stale"], key, batch=label)
            finally:
                batch.unpersist()
        runs.move({"batch": label, "outcome": outcome or "committed", "version": version}, noted)

    return job


def index_job(index: Table, runs: Pointer, own_host: str, archived: str | None = None, protected: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] | None = None, name: str = "index", order: str = "source_url") -> Batch:
    """Each batch is a whole crawl (source_url, dropdown_url, dropdown_title, title, content): its chunks are put in where their id is new, and those
    that it has no more go, unless their page is protected (url). Refused if no page is usable, or too many pages would vanish."""
    def plan(batch, now):
        fresh = materialise(chunk_pages(batch, own_host, order), "job-chunks")
        marked = materialise(sync.stale_plan(now, fresh, protected), "job-plan")
        gate = sync.stale_gate(marked).first()
        refused = "no usable page" if not fresh.limit(1).count() else "too many pages would vanish" if gate.aborted else None
        rows = fresh.join(now.select("chunk_id"), "chunk_id", "left_anti")
        rows = embed(rows) if embed is not None else rows
        lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema.fields if f.name not in rows.columns]
        return {"rows": rows.select("*", *lacking).select(now.columns), "stale": marked.filter("action = 'stale'").select("chunk_id"), "refused": refused}

    return _run(name, index, runs, plan, archived, "chunk_id")


def freshness_job(index: Table, runs: Pointer, approved: DataFrame, health: DataFrame, own_host: str, archived: str | None = None, name: str = "freshness", order: str = "source_url") -> Batch:
    """Each batch holds pages that were fetched anew (source_url, dropdown_url, dropdown_title, title, content, content_hash, video_url): chunks of new and
    changed pages replace those of before, chunks of removed pages go, refresh counts go up by one. Refused when the breaker trips."""
    def plan(batch, now):
        state = sync.current_state(now)
        actions = materialise(sync.freshness(approved, health, state, batch), "job-actions")
        if sync.freshness_breaker(actions, state).first().tripped:
            return {"refused": "too many pages would be removed"}
        of = lambda kinds: actions.filter(F.col("action").isin(*kinds)).select("url")
        renewed = batch.join(of(("new", "changed")).select(U.lowered_url(F.col("url")).alias("_u")).distinct(), U.lowered_url(F.col("source_url")) == F.col("_u"), "left_semi")
        counts = sync.refresh_counts(now).withColumnRenamed("refresh_count", "_n")
        rows = chunk_pages(renewed, own_host, order).drop("refresh_count")
        ident = U.lowered_url(F.coalesce(U.blank_to_null(F.col("dropdown_url")), F.col("source_url")))
        rows = rows.withColumn("identity", ident).join(counts, "identity", "left").withColumn("refresh_count", F.coalesce(F.col("_n") + 1, F.lit(0)).cast(now.schema["refresh_count"].dataType))
        lacking = [F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema.fields if f.name not in rows.columns]
        rows = materialise(rows.select("*", *lacking).select(now.columns), "job-rows")
        gone = sync.chunks_of(now, actions.filter("action LIKE 'removed_%' OR action = 'changed'").select("url")).select("chunk_id")
        return {"rows": rows, "stale": gone.join(rows.select("chunk_id"), "chunk_id", "left_anti"), "refused": None}

    return _run(name, index, runs, plan, archived, "chunk_id")


def answers_job(index: Table, runs: Pointer, hosts: list[str], name: str = "answers") -> Batch:
    """Each batch is a whole sheet of answers (as validate_answers() takes it): its entries replace those of the index (entry_id, question, answer, intent,
    scenario). Refused if a row has an error, or too many entries would go."""

    def plan(batch, now):
        rows = materialise(sync.validate_answers(batch, hosts), "job-answers")
        if bad := rows.filter(F.size("errors") > 0).count():
            return {"refused": f"{bad} rows with errors"}
        wanted = rows.select("entry_id", "question", "answer", "intent", "scenario")
        changes = sync.three_way(now, wanted, "entry_id")
        refused = "too many entries would go" if sync.removal_gate(changes).first().refused else None
        return {"rows": wanted, "stale": changes.filter("change = 'deleted'").select("entry_id"), "refused": refused}

    return _run(name, index, runs, plan, None, "entry_id")
