"""What changed between two versions of pages: lines, words of lines that were rewritten, and metadata.

Two sequences are aligned by anchors: items that occur once in both, of which a longest rising run is kept. The anchors cut both sequences
into gaps, and what is unique in a gap makes the next anchors; in the last round the first, second, ... occurrence of an item in a gap is
one of its own. Finding, counting and joining items is done over rows, for all pages at once; only a gap whose anchors
cross is looked at by itself, for its rising run.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .markdown import numbered_lines

ROUNDS = ("unique", "unique", "occurrence")
_SHOWN = 3  # words at both ends of what stays, if it is more than twice as many


def rising(places: list[int]) -> list[int]:
    """Indices of a longest run of places that rises, of the longest the one with the least ends."""
    ends, heads, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(ends, p)
        before.append(heads[k - 1] if k else -1)
        ends[k : k + 1], heads[k : k + 1] = [p], [i]
    out, i = [], heads[-1] if heads else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _gaps(side: DataFrame, keys: list[str]) -> DataFrame:
    """side with gap: how many of its rows before one have a mate."""
    return side.withColumn("gap", F.sum(F.col("mate").isNotNull().cast("int")).over(Window.partitionBy(*keys).orderBy("pos")))


def aligned(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """old and new (keys, pos, item) with mate, the pos of the row of the other side that it stays as, null where there is none, and gap: how many rows with
    mates come before, the row itself included. Mates rise together. Null items are never alike."""
    kept = [materialise(df.select(*keys, "pos", "item"), "side") for df in (old, new)]  # else each round would make them again
    sides, mates = [side.withColumn("mate", F.lit(None).cast("int")) for side in kept], None
    rise = F.udf(lambda places: None if places is None else rising(list(places)), "array<int>", useArrow=True)

    for kind in ROUNDS:
        lone = []
        for side, name in zip(sides, ("old", "new"), strict=True):
            free = _gaps(side, keys).filter("mate IS NULL AND item IS NOT NULL")
            by = [*keys, "gap", "item"]
            if kind == "occurrence":
                free = free.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
                by.append("nth")
            lone.append(free.groupBy(*by).agg(F.count("*").alias(f"n_{name}"), F.min("pos").alias(name)).filter(F.col(f"n_{name}") == 1))
        both = lone[0].join(lone[1], by).select(*keys, "gap", "old", "new")
        gaps = both.groupBy(*keys, "gap").agg(F.array_sort(F.collect_list(F.struct("old", "new"))).alias("pairs"))
        news = F.col("pairs.new")
        gaps = gaps.withColumn("run", rise(F.when(news != F.sort_array(news), news)))  # most gaps are one run as they are
        stay = F.coalesce(F.transform("run", lambda i: F.col("pairs")[i]), F.col("pairs"))
        found = materialise(gaps.select(*keys, F.explode(stay).alias("p")).select(*keys, F.col("p.old").alias("pos"), F.col("p.new").alias("mate")), "mates")
        mates = mates.unionByName(found) if mates else found
        back = mates.select(*keys, F.col("mate").alias("pos"), F.col("pos").alias("mate"))
        sides = [side.join(pairs, [*keys, "pos"], "left") for side, pairs in zip(kept, (mates, back), strict=True)]
    return tuple(materialise(_gaps(side, keys), "aligned") for side in sides)


def _items(pages: DataFrame, key: str, content: str) -> DataFrame:
    rows = pages.select(key, F.explode(numbered_lines(F.col(content))).alias("l")).select(key, "l.line", F.col("l.text").alias("item"))
    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("line")).alias("pos"), "item")


def rewritten(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, gap, nth, old and new: lines of gaps with as many lines gone as came, one by one. old, new: both sides of aligned()."""
    free = lambda side, name: side.filter("mate IS NULL").select(
        key, "gap", F.col("item").alias(name), F.row_number().over(Window.partitionBy(key, "gap").orderBy("pos")).alias("nth"), F.count("*").over(Window.partitionBy(key, "gap")).alias("_n")
    )
    return free(old, "old").join(free(new, "new"), [key, "gap", "nth", "_n"]).drop("_n")


def word_changes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and words of pairs (keys, old, new): both texts in one, [-gone-] and {+come+}, what stays shortened to three words at both ends if it is more
    than six."""
    words = lambda c: pairs.select(*keys, F.posexplode(F.filter(F.split(c, " "), lambda w: w != "")).alias("pos", "item"))
    a, b = aligned(words("old"), words("new"), keys)
    change = lambda side, kind: side.filter("mate IS NULL").select(*keys, "gap", F.lit(kind).alias("kind"), "pos", "item")
    rows = change(a, 1).unionByName(change(b, 2)).unionByName(a.filter("mate IS NOT NULL").select(*keys, "gap", F.lit(0).alias("kind"), "pos", "item"))
    order = Window.partitionBy(*keys).orderBy("gap", "kind", "pos")
    turns = F.coalesce((F.lag("kind").over(order) > 0) != (F.col("kind") > 0), F.lit(True)) | ((F.col("kind") > 0) & (F.lag("gap").over(order) != F.col("gap")))
    rows = rows.withColumn("run", F.sum(turns.cast("int")).over(order))
    text = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("gap", "pos", "item")))), lambda x: x["item"])
    runs = rows.groupBy(*keys, "run").agg(*[text(k).alias(n) for k, n in enumerate(("stays", "gone", "come"))])
    joined = lambda c: F.array_join(c, " ")
    stays = F.when(F.size("stays") <= 2 * _SHOWN, joined("stays")).otherwise(F.concat(joined(F.slice("stays", 1, _SHOWN)), F.lit(" ... "), joined(F.slice("stays", -_SHOWN, _SHOWN))))
    marked = lambda c, a, z: F.when(F.size(c) > 0, F.concat(F.lit(a), joined(c), F.lit(z))).otherwise("")
    shown = F.when(F.size("stays") > 0, stays).otherwise(F.concat(marked("gone", "[-", "-]"), marked("come", "{+", "+}")))
    said = F.array_sort(F.collect_list(F.struct("run", shown.alias("t"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(said, lambda x: x["t"]), " ").alias("words"))


def compared(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """key, old_lines, new_lines, same, similarity (percent of lines that stay), added, removed and words (of rewritten lines, in order) of the pages that both
    versions have. Lines are compared without empty ones, white space as one blank; keys must be unique."""
    keys = old.select(key).join(new.select(key), key)
    a, b = aligned(_items(old.join(keys, key, "left_semi"), key, content), _items(new.join(keys, key, "left_semi"), key, content), [key])
    count = lambda side, n, free: side.groupBy(key).agg(F.count("*").cast("int").alias(n), F.count_if(F.col("mate").isNull()).cast("int").alias(free))
    changed = word_changes(rewritten(a, b, key).withColumnsRenamed({"gap": "_gap", "nth": "_nth"}), [key, "_gap", "_nth"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_gap", "_nth", "words"))), lambda x: x["words"])
    out = keys.join(count(a, "old_lines", "removed"), key, "left").join(count(b, "new_lines", "added"), key, "left").join(changed.groupBy(key).agg(listed.alias("words")), key, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    lines = n("old_lines") + n("new_lines")
    alike = F.when(lines > 0, F.round(200 * (n("old_lines") - n("removed")) / F.nullif(lines, F.lit(0)), 1)).otherwise(100.0)
    return out.select(
        key, n("old_lines").alias("old_lines"), n("new_lines").alias("new_lines"), ((n("removed") == 0) & (n("added") == 0)).alias("same"), alike.alias("similarity"),
        n("added").alias("added"), n("removed").alias("removed"), F.coalesce("words", F.array().cast("array<string>")).alias("words"),
    )


def metadata_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, old and new of every field of the pages that both versions have which isn't the same; null and empty are the same."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    side = lambda df, name: df.select(key, F.array(*[F.struct(F.lit(f).alias("field"), text(F.col(f)).alias("v")) for f in fields]).alias(name))
    both = side(old, "o").join(side(new, "n"), key).select(key, F.explode(F.arrays_zip("o", "n")).alias("z"))
    return both.select(key, F.col("z.o.field").alias("field"), F.col("z.o.v").alias("old"), F.col("z.n.v").alias("new")).filter("old <> new")


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Pages that only one version has: key and change (added or removed)."""
    a, b = old.select(key, F.lit(1).alias("_o")), new.select(key, F.lit(1).alias("_n"))
    return a.join(b, key, "full_outer").filter("_o IS NULL OR _n IS NULL").select(key, F.when(F.col("_o").isNull(), "added").otherwise("removed").alias("change"))
