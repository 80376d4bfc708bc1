"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir

__all__ = ["SPACE", "WORD", "bound", "filtered_joins", "fresh", "materialise", "shared_dir", "shuffle_partitions", "slices", "table", "whole"]

#: What separates words everywhere in this subpackage: the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def filtered_joins(spark: SparkSession):
    """Joins that run inside filter their large side by a Bloom filter of the other's keys before they shuffle it, however small the
    large side is. Spark keeps the filter within its own bounds of size, and does without it beyond them."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches, rows: int = 256):
    """Arrow batches in slices of at most rows rows, so that what a Python worker makes of one stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def fresh(name: str, columns: list[str]) -> str:
    """name, or the first longer one that none of columns has."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def whole(col: str) -> "F.Column":
    """A text column with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def bound(value, fn):
    """fn(value) with value computed once for a row, also where fn uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), fn), 1)
