"""Content operators: cleaning, hashing, chunking, change detection and sync plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments, navigation and footers go, tags become blanks, white space is one blank."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style|nav|footer)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def chunks(df: DataFrame, text: str = "text", words: int = 200, overlap: int = 40) -> DataFrame:
    """df with one row a window of words: chunk_index, total_chunks and chunk. A text without words has none."""
    split = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    step = words - overlap
    n = F.greatest(F.lit(1), F.ceil((F.size("_w") - overlap) / step).cast("int"))
    at = F.explode(F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    cut = df.withColumn("_w", split).withColumn("total_chunks", n).withColumn("chunk_index", at)
    return cut.withColumn("chunk", F.array_join(F.slice("_w", F.col("chunk_index") * step + 1, words), " ")).drop("_w")


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and change: added, deleted, changed or same, between two snapshots of one row a key."""
    o, n = old.select(key, F.col(digest).alias("_old")), new.select(key, F.col(digest).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return table.join(rows, key, "left_anti").unionByName(rows)
