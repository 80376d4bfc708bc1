"""N-gram Jaccard join by MinHash banding.

A document is the set of its N-word shingles. Documents of equal sets are one node,
known by a number, and meet once. Rows a band and the number of bands follow from
the threshold and the target recall at it. Classes that share a band meet by a shuffle on the
band's hash; the smallest label spreads over the bands to candidate groups, each
class's full set, made anew from its text, goes to its group once for each pair of
blocks, and every pair in a group is verified there on full sets, by blocks of a
product of incidence matrices. What leaves a task is a number of links for each
class and a forest of links, never the pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import WORD, filtered_joins, fresh, materialise, slices, table, whole

N, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9995, 4
#: Classes in a block, and shingles: a task holds the sets of two blocks.
BLOCK, SHINGLES = 256, 1 << 20
#: Edges of a hub beyond which it is split.
SPLIT = 64
#: Into how many keys a group is dealt to learn its number of parts.
SALT = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands with which a pair at the threshold meets with the target recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _signatures(n_rows: int):
    seeds = _mix(np.arange(1, n_rows + 1, dtype=np.uint64) * _ODD)

    def sign(shingles: np.ndarray) -> np.ndarray:
        low = np.full(n_rows, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 2048):
            part = shingles[i : i + 2048, None] ^ seeds[None, :]
            part = (part ^ (part >> np.uint64(32))) * _ODD
            low = np.minimum(low, part.min(axis=0))
        return low

    return sign


def _hashed(docs: DataFrame, *columns: str) -> DataFrame:
    """columns of docs, and _near_hashes: those of its text's words."""
    words = F.regexp_extract_all(whole("text"), F.lit(f"({WORD})"), F.lit(1))
    return docs.select(*columns, F.transform(words, lambda w: F.xxhash64(w)).alias(fresh("_near_hashes", docs.columns)))


def _shingles(hashes: pa.Array, n: int):
    """For each list of word hashes the distinct hashes of its n-word shingles, sorted. Fewer words, but at least one, are one
    shingle; no words have an empty set, which is like nothing."""
    flat, at = hashes.values.to_numpy(), hashes.offsets.to_numpy()
    for begin, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        w = _mix(flat[begin:end].view(np.uint64))
        k = min(n, len(w))
        s = np.zeros(max(0, len(w) - k + 1) if k else 0, np.uint64)
        for j in range(k):
            s = (s * _ODD + w[j : j + len(s)]) ^ (s >> np.uint64(29))
        yield np.unique(s)


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.sha256(shingles.tobytes()).digest()[:16]


def signed(docs: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """doc_id, key (of the set of shingles; null if that is empty), size of the set and hubs (the hashes of its bands) of each row. Sets
    stay behind."""

    def run(batches):
        signer, numbers = _signatures(rows * bands), np.arange(bands, dtype=np.uint64) * _ODD
        for batch in slices(batches):
            keys, sizes, hubs = [], [], []
            for s in _shingles(batch.column(1), n):
                h = numbers.copy()
                sig = signer(s).reshape(bands, rows)
                for j in range(rows):
                    h = _mix(h ^ sig[:, j])
                keys.append(_key(s) if len(s) else None)
                sizes.append(len(s))
                hubs.append(h.view(np.int64) if len(s) else np.zeros(0, np.int64))
            cols = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hubs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "key", "size", "hubs"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _hashed(slim, "doc_id").mapInArrow(run, "doc_id bigint, key binary, size bigint, hubs array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """id and set of each row (id, doc_id, key) of wanted: made anew from the texts, so that only sets with candidates are ever moved."""

    def run(batches):
        for batch in slices(batches):
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            made = [(i, s.tobytes()) for i, key, s in zip(ids, keys, _shingles(batch.column(2), n), strict=True) if _key(s) == key]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], ["id", "set"])

    # The condition always holds; the optimizer makes a Bloom filter only of a side that has one.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.filter("copies > 0").select("id", "doc_id", "key"), "doc_id")
    return _hashed(texts, "id", "key").mapInArrow(run, "id bigint, set binary").dropDuplicates(["id"])


def split_hubs(edges: DataFrame) -> DataFrame:
    """edges (id, hub, m: the edges of the hub) as (id, hub: struct): a hub of many edges becomes about sqrt(m) hubs of as many, and one
    of their least ids, so that no task reads all edges of a hub. What is connected stays the same."""
    salt = F.when(F.col("m") > SPLIT, F.pmod(F.xxhash64("id"), F.ceil(F.sqrt("m")).cast("long"))).otherwise(F.lit(-1).cast("long"))
    dealt = edges.select("id", F.struct("hub", salt.alias("salt")).alias("hub"))
    tops = dealt.filter("hub.salt >= 0").groupBy("hub").agg(F.min("id").alias("id"))
    return dealt.unionByName(tops.select("id", F.struct("hub.hub", F.lit(-1).cast("long").alias("salt")).alias("hub")))


def components(nodes: DataFrame, edges: DataFrame, tag: str) -> DataFrame:
    """nodes (id), edges (id, hub: any key) -> (id, label): the least id that the ids sharing hubs lead to. Labels spread by
    aggregation alone, so a hub of many ids is combined before it is shuffled, and jump to their labels' labels, so that a chain of n ids
    takes about log n rounds. Nodes without edges keep their own id; repeated edges change nothing; no nodes give no labels. Ids of
    edges that aren't among nodes are left out."""
    labels = materialise(nodes.select("id", F.col("id").alias("label")), tag)
    while True:
        hubs = edges.join(labels, "id").groupBy("hub").agg(F.min("label").alias("label"))
        near = edges.join(hubs, "hub").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.coalesce(F.least("label", "near"), "label").alias("to"), "label")
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("far"))
        step = materialise(step.join(jump, "to", "left").select("id", F.least("to", F.coalesce("far", "to")).alias("now"), "label"), tag)
        moved = step.filter("now <> label").limit(1).count()
        labels = step.select("id", F.col("now").alias("label"))
        if not moved:
            return labels


_LINKS = ["id", "n", "hub", "p", "q"]


def _verify(threshold: float):
    """For a pair of blocks, p and q: the number of links of each set, and a forest of links, whose trees are hubs of that pair alone, so that
    none has more members than two blocks."""

    def run(key, table_):
        pdf = table_.to_pandas()
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same = key[1].as_py() == key[2].as_py()
        b = a if same else b
        if not len(a) or not len(b):  # a part that no set fell into
            return pa.table({n: pa.array([], pa.int64()) for n in _LINKS})
        sets_a, sets_b = ([np.frombuffer(x, np.uint64) for x in side["set"]] for side in (a, b))
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets_b]))
        met = np.zeros((len(a), len(b)), np.int64)
        at_b = [np.searchsorted(every, s) for s in sets_b]
        flat, owner = np.concatenate(at_b), np.repeat(np.arange(len(b)), [len(s) for s in sets_b])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        starts = np.searchsorted(flat, np.arange(len(every) + 1))
        for i, s in enumerate(sets_a):
            at = np.searchsorted(every, s)
            at = at[(at < len(every)) & (every[np.minimum(at, len(every) - 1)] == s)]
            if len(at):
                n = starts[at + 1] - starts[at]
                inside = np.repeat(starts[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                met[i] = np.bincount(owner[inside], minlength=len(b))
        sizes_a, sizes_b = (np.array([len(s) for s in side]) for side in (sets_a, sets_b))
        union = sizes_a[:, None] + sizes_b[None, :] - met
        link = met >= threshold * union - 1e-9
        if same:
            np.fill_diagonal(link, False)
        ids_a, ids_b = a["id"].tolist(), b["id"].tolist()
        rows = [(i, int(n), None) for i, n in zip(ids_a, link @ b["copies"].to_numpy(), strict=True)]
        if not same:
            rows += [(i, int(n), None) for i, n in zip(ids_b, link.T @ a["copies"].to_numpy(), strict=True)]
        parent: dict[int, int] = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(*np.nonzero(link), strict=True):
            x, y = root(ids_a[i]), root(ids_b[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
        rows += [(x, 0, root(x)) for x in list(parent)]
        place = [pa.array([k.as_py()] * len(rows), pa.int64()) for k in key[1:]]
        return pa.Table.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), *place], _LINKS)

    return run


def _joined(docs: DataFrame, n: int, threshold: float, recall: float, rows: int) -> DataFrame:
    """doc_id, key, class_id, copy_of, n_links and first (whether the row's set is that of its class with the least doc_id, then key) for each
    row of docs; all but doc_id are null for empty sets."""
    bands = bands_for(threshold, recall, rows)
    every = materialise(signed(docs, n, rows, bands), "near-signed")
    known = every.filter("key is not null and doc_id is not null")
    copies = known.groupBy("key").agg(F.min(F.struct("doc_id", "size", "hubs")).alias("first"), F.count("*").alias("copies"))
    copies = copies.select("key", "first.doc_id", "first.size", "first.hubs", "copies")
    # A number for each different set, so that texts of one doc_id are told apart; it is fixed when the table is written.
    copies = materialise(copies.withColumn("id", F.monotonically_increasing_id()), "near-copies")
    bound = copies.select("id", F.explode("hubs").alias("hub"))
    shared = bound.groupBy("hub").agg(F.count("*").alias("m")).filter("m > 1")
    edges = materialise(split_hubs(bound.join(shared, "hub")), "near-edges")
    groups = components(edges.select("id").distinct(), edges, "near-groups").withColumnRenamed("label", "grp")
    # Blocks of a group: by a hash, in as many parts as its sets or their shingles ask for; each pair of parts is a task's work.
    slim = groups.join(copies.select("id", "doc_id", "key", "size", "copies"), "id")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / SHINGLES))
    # Few groups have several parts; theirs are dealt out by SALT, so that no task reads all rows of a large group.
    large = slim.groupBy("grp").agg(parts.alias("parts")).filter("parts > 1").select("grp", "parts", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = slim.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(SALT)).cast("int"))
    placed = salted.join(large, ["grp", "salt"], "left").drop("salt").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    placed = materialise(placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))), "near-placed")
    work = placed.select("id", "copies", "grp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    side = F.when(F.col("part") <= F.col("other"), 0).otherwise(1)
    work = work.select("id", "copies", "grp", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), side.alias("side"))
    work = work.join(sets_of(docs, placed, n), "id")
    with filtered_joins(docs.sparkSession):
        done = materialise(work.groupBy("grp", "p", "q").applyInArrow(_verify(threshold), ", ".join(f"{c} bigint" for c in _LINKS)), "near-links")
    links = done.groupBy("id").agg(F.sum("n").alias("n"))
    hubs = done.filter("hub is not null").select("id", F.struct("hub", "p", "q").alias("hub"))
    classes = components(hubs.select("id").distinct(), hubs, "near-classes")
    members = classes.join(copies.select("id", "doc_id", "key"), "id")
    least = members.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min_by("id", F.struct("doc_id", "key")).alias("top"))
    classes = classes.join(least, "label").select("id", "class_id", "top")
    reps = copies.join(links, "id", "left").join(classes, "id", "left")
    n_links = F.coalesce("n", F.lit(0)) + F.col("copies") - 1
    first = F.coalesce(F.col("top") == F.col("id"), F.lit(True))
    reps = reps.select("key", F.col("doc_id").alias("copy_of"), F.coalesce("class_id", "doc_id").alias("class_id"), first.alias("first"), n_links.alias("n_links"))
    return every.select("doc_id", "key").join(reps, "key", "left")


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, class_id (the least doc_id that links lead to), copy_of (the least doc_id with
    the same shingles) and n_links: how many other rows have a Jaccard similarity of at least threshold with it, copies included.

    Null and empty texts, and rows with a null id, link to nothing. Different texts of one doc_id are judged each by itself, and link
    if they are alike; repeated rows are copies of each other. Of a very long text only the shingles' hashes are held. Other columns of
    docs are not carried, whatever their names. An empty table gives an empty result.
    """
    out = _joined(docs, n, threshold, recall, rows)
    known = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c))
    cols = [F.coalesce(known(c), "doc_id").alias(c) for c in ("class_id", "copy_of")]
    return out.select("doc_id", *cols, F.coalesce(known("n_links"), F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row of each class, that with the least doc_id; columns as in docs. Of repeated rows, equal in doc_id and shingles, one stays.
    Rows without an id, and those without words, are classes of their own: all of them stay. Different texts of one doc_id stay or go
    each by its own class."""
    joined = _joined(docs.select("doc_id", "text"), n, threshold, recall, rows).filter("doc_id is not null")
    won = F.col("key").isNull() | (F.col("first") & (F.col("doc_id") == F.col("copy_of")))
    joined = materialise(joined.select("doc_id", "key", won.alias("won")), "near-won")
    many = joined.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("won").alias("won")).filter("won")
    names = docs.columns
    only, won_id, won_key, key = (fresh(n, names) for n in ("_near_only", "_near_won_id", "_near_won_key", "_near_key"))
    is_only = F.col("doc_id").cast("long") == F.col(only)
    # The ids have no bound: their side is dealt by hash, never broadcast, and the texts are not sorted.
    out = docs.join(many.filter("n = 1").select(F.col("doc_id").alias(only)).hint("shuffle_hash"), is_only, "left_semi")
    out = out.unionByName(docs.filter("doc_id is null"))
    if not many.filter("n > 1").limit(1).count():
        return out
    # The few ids of several rows: their keys are made anew, to tell which of the texts won.
    again = docs.join(many.filter("n > 1").select(F.col("doc_id").alias(only)), is_only, "left_semi")

    def keyed(batches):
        for batch in slices(batches):
            keys = [_key(s) if len(s) else None for s in _shingles(batch.column(len(names)), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(keys, pa.binary())], [*names, key])

    again = _hashed(again, *names).mapInArrow(keyed, StructType([*docs.schema.fields, StructField(key, BinaryType())]))
    winners = joined.filter("won and key is not null").select(F.col("doc_id").alias(won_id), F.col("key").alias(won_key)).distinct()
    won_by = (F.col("doc_id").cast("long") == F.col(won_id)) & (F.col(key) == F.col(won_key))
    texts = again.join(winners, won_by, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    blank = again.filter(F.col(key).isNull()).drop(key)
    return out.unionByName(texts).unionByName(blank)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))
