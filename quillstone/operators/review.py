"""Duplicate groups, history and the sliding-window limiter over a table of events."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, key: Column, order: str) -> DataFrame:
    """key, n and survivor (the least of order) of each key with two rows or more."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("survivor")).filter("n > 1")


def clean_history(turns: DataFrame, refused: Column) -> DataFrame:
    """turns (conv_id, turn, role, ...) without refused assistant turns and the user turn right before each."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    marked = turns.withColumn("_bad", F.coalesce((F.lower("role") == "assistant") & refused, F.lit(False)))
    marked = marked.withColumn("_next", F.coalesce(F.lead("_bad").over(order), F.lit(False)))
    return marked.filter(~F.col("_bad") & ~(F.col("_next") & (F.lower("role") == "user"))).drop("_bad", "_next")


def limited(events: DataFrame, key: str, at: str, order: str, limits: tuple[tuple[int, int], ...] = ((10, 60), (100, 3600))) -> DataFrame:
    """events with accepted: no window (n, seconds) before an event holds n accepted events of its key. Rejected ones don't count.

    Keys are sorted inside partitions and read as a stream: a task holds at most the largest n events of one key. Whether an event is accepted
    depends on all of its key before it, so one key is one task's work, in order; null keys are one key.
    """
    most = max(n for n, _ in limits)

    def run(batches):
        now, log = None, deque(maxlen=most)
        for batch in batches:
            ok = []
            for k, t in zip(batch.column("_key").to_pylist(), batch.column("_at").to_pylist(), strict=True):
                if k != now:
                    now = k
                    log.clear()
                good = all(len(log) < n or t - log[-n] >= seconds * 1_000_000 for n, seconds in limits)
                if good:
                    log.append(t)
                ok.append(good)
            yield batch.drop_columns(["_key", "_at"]).append_column("accepted", pa.array(ok, pa.bool_()))

    kept = events.columns
    at_ = F.unix_micros(F.coalesce(F.col(at).cast("timestamp"), F.lit(0).cast("timestamp")))
    keyed = events.withColumn("_key", F.coalesce(F.col(key).cast("string"), F.lit(""))).withColumn("_at", at_)
    dealt = keyed.repartition("_key").sortWithinPartitions("_key", "_at", order)
    return dealt.mapInArrow(run, events.select(kept).withColumn("accepted", F.lit(True)).schema)
