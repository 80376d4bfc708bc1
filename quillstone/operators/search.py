"""Exhaustive vector search and lexical ranking, for a stated set of queries against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.when(norms > 0, norms), F.lit(0.0))


def top(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key, with their rank. The limit on the rank is applied before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


#: Vectors in a block of the table, and queries in a block.
ROWS, QUERIES = 4096, 1024
#: Different words of a set of queries up to which its index is held by each worker.
VOCABULARY = 200_000
#: Queries up to which each worker holds their words and scores.
ASKED = 20_000


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(vids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """query, vector and score of the k best of v (vectors in rows) for each of q, itself left out; the least of vids of equals.

    A cosine is summed one dimension after the other and rounded, halves away from zero, to 12 places, so that two vectors have one score in
    whatever block they meet, and equal vectors have equal scores. A matrix product, whose last digits depend on the block, only says which
    vectors are so near that they can be among the best.
    """
    order = np.argsort(vids, kind="stable")
    vids, v = vids[order], v[order]
    near = _unit(q) @ _unit(v).T
    near[(qids[:, None] == vids[None, :]) | ~np.isfinite(near)] = -np.inf
    qt, vt = np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
    total = lambda pairs, n: sum(pairs, np.zeros(n))  # noqa: E731 one after the other, as an aggregate over the array does
    with np.errstate(over="ignore", invalid="ignore"):
        qn, vn = (np.sqrt(total((x * x for x in m), m.shape[1])) for m in (qt, vt))
    k, out = min(k, len(vids)), []
    for i in range(0, len(qids), 64):
        part = near[i : i + 64]
        least = np.partition(part, len(vids) - k, axis=1)[:, len(vids) - k, None]
        at, of = np.nonzero((part >= least - 1e-9) & (part > -np.inf))
        norm = qn[at + i] * vn[of]
        with np.errstate(over="ignore", invalid="ignore"):
            dot = total((a[at + i] * b[of] for a, b in zip(qt, vt, strict=True)), len(at))
            score = 1e12 * np.divide(dot, norm, out=np.zeros(len(at)), where=(norm > 0) & np.isfinite(norm))
        floor = np.trunc(score)
        score = (floor + np.sign(score) * (np.abs(score - floor) >= 0.5)) / 1e12
        order = np.lexsort((of, -score, at))
        at, of, score = at[order], of[order], score[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((qids[at[kept] + i], vids[of[kept]], score[kept]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _blocks(df: DataFrame, key: str, vector: str, size: int, prefix: str) -> DataFrame:
    """Rows of at most size keys and their vectors, as bytes of 64-bit numbers. Nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                m = np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], [f"{prefix}ids", f"{prefix}rows"])

    slim = df.select(F.col(key).cast("long").alias("k"), vector).filter(F.col("k").isNotNull() & (F.size(vector) > 0))
    return slim.mapInArrow(run, f"{prefix}ids array<bigint>, {prefix}rows binary")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of vectors (vec_id, embedding) by cosine to each of queries (query_id, query), itself left
    out; the least vec_id of equals. Rows without id or vector are left out; a vector without length has score 0.

    Exhaustive, by blocks: every block of vectors meets every block of queries in one matrix product, and only the k best of each query leave it, with
    scores that don't depend on the blocks.
    """
    pairs = _blocks(vectors, "vec_id", "embedding", ROWS, "v").crossJoin(_blocks(queries, "query_id", "query", QUERIES, "q"))

    def run(batches):
        for batch in batches:
            for v, vr, q, qr in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vids, qids = np.array(v, np.int64), np.array(q, np.int64)
                cols = _best(vids, np.frombuffer(vr).reshape(len(vids), -1), qids, np.frombuffer(qr).reshape(len(qids), -1), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    scored = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    return top(scored, "query_id", k, F.desc("score"), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, most: int = VOCABULARY) -> DataFrame:
    """query_id, rank, doc_id and score of the k best of docs (doc_id, words) for each of queries (query_id: a whole number, words).

    Statistics cover all docs. A set of at most ASKED queries and `most` different words is held by each worker as an index from words to queries: a
    batch of documents is scored in one pass, and only its k best of each query leave it. A larger set meets the documents by joins on words.
    """
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "words").filter("query_id IS NOT NULL")
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    totals = docs.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean"))
    vocabulary = asked.select("word").distinct()
    if vocabulary.limit(most + 1).count() > most or queries.limit(ASKED + 1).count() > ASKED:
        return _bm25_by_joins(docs, asked, totals, k, k1, b)
    seen = docs.select(F.explode(F.array_distinct("words")).alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("df"))
    n, mean = totals.first()
    index: dict[str, list] = {r.word: [float(np.log(1 + (n - r.df + 0.5) / (r.df + 0.5))), []] for r in seen.collect()}  # at most `most` words
    ids = sorted(r.query_id for r in queries.select("query_id").distinct().collect())
    place = {q: i for i, q in enumerate(ids)}
    for q, w in asked.collect():
        if w in index:
            index[w][1].append(place[q])
    shared = docs.sparkSession.sparkContext.broadcast({w: (idf, np.array(at, np.int64)) for w, (idf, at) in index.items()})

    def run(batches):
        known = shared.value
        for batch in batches:
            names = batch.column(0).to_pylist()
            scores = np.zeros((len(ids), len(names)))
            for j, words in enumerate(batch.column(1).to_pylist()):
                tf: dict[str, int] = {}
                for w in words or ():
                    if w in known:
                        tf[w] = tf.get(w, 0) + 1
                base = k1 * (1 - b + b * len(words or ()) / (mean or 1))
                for w, f in tf.items():
                    idf, at = known[w]
                    scores[at, j] += idf * f * (k1 + 1) / (f + base)
            scores = np.round(scores, 8)
            order = np.argsort(np.array([-1 if d is None else d for d in names], np.int64), kind="stable")
            best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
            score = np.take_along_axis(scores, best, 1).ravel()
            rows = [(ids[i // best.shape[1]], names[j], s) for i, (j, s) in enumerate(zip(best.ravel().tolist(), score.tolist(), strict=True)) if s > 0]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["query_id", "doc_id", "score"]).astype({"query_id": "int64", "doc_id": "int64", "score": "float64"}), preserve_index=False)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "words").filter("doc_id IS NOT NULL")
    found = slim.mapInArrow(run, "query_id bigint, doc_id bigint, score double")
    return top(found, "query_id", k, F.desc("score"), F.col("doc_id")).select("query_id", "rank", "doc_id", "score")


def _bm25_by_joins(docs: DataFrame, asked: DataFrame, totals: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """Words that no query has leave before the shuffle."""
    counts = docs.select("doc_id", F.size("words").alias("size"), F.explode("words").alias("word")).join(asked.select("word").distinct(), "word")
    counts = counts.groupBy("word", "doc_id", "size").agg(F.count("*").alias("tf"))
    seen = counts.groupBy("word").agg(F.count("*").alias("df"))
    weighed = counts.join(seen, "word").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    scored = weighed.select("word", "doc_id", weight.alias("w")).join(asked, "word").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 8).alias("score"))
    return top(scored, "query_id", k, F.desc("score"), F.col("doc_id")).select("query_id", "rank", "doc_id", "score")


def closest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, f1 and jaccard of each row of docs (doc_id, words): the item of items (item_id, words) with the highest F1 of
    the overlap of their sets of words, the least item_id of equals. Both scores are 0 if either set is empty or there is no item.

    Up to ASKED items are held whole by each worker: an index from words to items, so that one pass over a document's words counts its
    overlap with every item. More meet the documents by joins on words. Jaccard rises with F1, so the item is the best by either.
    """
    if items.limit(ASKED + 1).count() > ASKED:
        return _closest_by_joins(docs, items)
    asked = sorted((r.item_id, sorted(set(r.words))) for r in items.select("item_id", "words").filter("item_id is not null").collect())
    shared = docs.sparkSession.sparkContext.broadcast(asked)  # the queries

    def run(batches):
        ids, n = [i for i, _ in shared.value], np.array([len(w) for _, w in shared.value], np.int64)
        index = {}
        for k, (_, words) in enumerate(shared.value):
            for w in words:
                index.setdefault(w, []).append(k)
        index = {w: np.array(at) for w, at in index.items()}
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            best = []
            for words in batch.column(1).to_pylist():
                words = set(words)
                hits = [index[w] for w in words if w in index]
                if not ids or not words:
                    best.append((min(ids, default=None), 0.0, 0.0))
                    continue
                met = np.bincount(np.concatenate(hits), minlength=len(ids)) if hits else np.zeros(len(ids), np.int64)
                k = int((2.0 * met / (len(words) + n)).argmax())
                best.append((ids[k], float(2.0 * met[k] / (len(words) + n[k])), float(met[k] / (len(words) + n[k] - met[k]))))
            cols = [pa.array([b[i] for b in best], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", "item_id", "f1", "jaccard"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.array_distinct("words").alias("words")).mapInArrow(run, f"doc_id {kind}, item_id bigint, f1 double, jaccard double")


def _closest_by_joins(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every row of docs is told apart, so that rows of one id each get their item; words that only one side has leave before the sums."""
    words = lambda df: F.array_distinct(F.coalesce("words", F.array().cast("array<string>")))
    rows = materialise(docs.select("doc_id", words(docs).alias("w")).withColumn("_r", F.monotonically_increasing_id()), "rows")
    sets = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), words(items).alias("y"))
    least = sets.agg(F.min("item_id").alias("_none"))
    hits = rows.select("_r", F.size("w").alias("a"), F.explode("w").alias("word")).join(sets.select("item_id", F.size("y").alias("b"), F.explode("y").alias("word")), "word")
    met = hits.groupBy("_r", "a", "item_id", "b").agg(F.count("*").alias("c"))
    f1, jaccard = 2.0 * F.col("c") / (F.col("a") + F.col("b")), F.col("c") / (F.col("a") + F.col("b") - F.col("c"))
    best = met.groupBy("_r").agg(F.min_by(F.struct("item_id", f1.alias("f1"), jaccard.alias("jaccard")), F.struct(-f1, "item_id")).alias("x"))
    out = rows.select("_r", "doc_id").join(best, "_r", "left").crossJoin(F.broadcast(least))  # one row
    zero = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(0.0)).alias(c)
    return out.select("doc_id", F.coalesce("x.item_id", "_none").alias("item_id"), zero("f1"), zero("jaccard"))
