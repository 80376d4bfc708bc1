"""An index of vectors by coarse centroids: lists of near vectors, of which a search reads a few.

The centroids are fitted on a bounded sample; every vector is indexed, in the list of its nearest centroid, and lists are stored in blocks
of matrices, as versions of a table. A search reads the lists that are nearest to a query. How many are enough is measured, against the
exhaustive search, on a sample of queries; reading all of them is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import Pointer, Table
from ..storage import materialise
from .search import QUERIES, ROWS, _best, _unit, nearest, top

#: Vectors that the centroids are fitted on, at most, and the greatest number of lists; so many that a list holds about the root of the rows.
SAMPLE, LISTS = 20_000, 4096


def fit(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 6) -> np.ndarray:
    """Centroids (one in a row, of length 1) of vectors (vec_id, embedding) with a length, by k-means on at most `sample` of them, chosen by a hash of the id. lists: by
    default the root of the number of vectors."""
    fine = vectors.filter(F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0))
    n = fine.count()
    if not n:
        return np.zeros((1, 0))  # one list, for all
    lists = max(1, min(lists or int(n**0.5), LISTS, sample, n))
    some = fine.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    if lists < 2:
        return _unit(np.array([r.v.toArray() for r in some.limit(1).collect()]).reshape(1, -1))
    model = KMeans(k=lists, seed=seed, maxIter=8, featuresCol="v", distanceMeasure="cosine").fit(some)
    return _unit(np.array(model.clusterCenters()))


def _nearest_lists(df: DataFrame, key: str, vector: str, centroids: np.ndarray, n: int) -> DataFrame:
    """list, key and vector: a row for each of the n lists nearest to each vector. The centroids, of which there are LISTS at most, are shared."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    n = min(n, len(centroids))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, QUERIES):
                part = batch.slice(i, QUERIES)
                m = _unit(np.array(part.column(1).to_pylist(), np.float64).reshape(part.num_rows, -1))
                near = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :n] if shared.value.size else np.zeros((len(m), 1), np.int64)
                at = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel(), pa.int64()), *(c.take(at) for c in part.columns)], ["list", "key", "v"])

    slim = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("key").isNotNull() & (F.size(vector) > 0))
    return slim.mapInArrow(run, "list bigint, key bigint, v array<double>")


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """list, ids and rows (bytes of vectors): blocks of at most size rows of one list. Ranges of (list, key) split a list of any length over tasks."""

    def run(batches):
        now, ids, held = None, [], []

        def block():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(held, np.float64).tobytes()], pa.binary())], ["list", "ids", "rows"])

        for batch in batches:
            for of, key, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (of != now or len(ids) >= size):
                    yield block()
                    ids, held = [], []
                now = of
                ids.append(key)
                held.append(v)
        if ids:
            yield block()

    return rows.repartitionByRange("list", "key").sortWithinPartitions("list", "key").mapInArrow(run, "list bigint, ids array<bigint>, rows binary")


class VectorIndex:
    """An index at a path: its centroids, its vectors (vec_id, embedding, list) and their blocks, each as versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.centroids_ = Pointer(spark, f"{path}/centroids")
        self.vectors, self.blocks = Table(spark, f"{path}/vectors"), Table(spark, f"{path}/blocks")

    def centroids(self) -> np.ndarray:
        value = self.centroids_.value()
        return np.array(value, np.float64).reshape(len(value), -1)

    def build(self, vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fits the centroids and indexes all of vectors (vec_id, embedding). Rows without id or vector are left out; of rows of one id all are indexed."""
        self.centroids_.move(fit(vectors, lists, sample).tolist(), self.centroids_.version())
        return self._write(self._listed(vectors))

    def _listed(self, vectors: DataFrame) -> DataFrame:
        return _nearest_lists(vectors, "vec_id", "embedding", self.centroids(), 1).select(F.col("key").alias("vec_id"), F.col("v").alias("embedding"), "list")

    def _write(self, rows: DataFrame) -> VectorIndex:
        self.vectors.write(rows)
        self.blocks.write(_packed(self.vectors.read().select("list", F.col("vec_id").alias("key"), F.col("embedding").alias("v")), ROWS))
        return self

    def upsert(self, vectors: DataFrame) -> VectorIndex:
        """Puts vectors in the place of those of the same id, by the centroids that are there."""
        return self._write(self.vectors.read().join(vectors.select("vec_id"), "vec_id", "left_anti").unionByName(self._listed(vectors)))

    def delete(self, ids: DataFrame) -> VectorIndex:
        return self._write(self.vectors.read().join(ids.select("vec_id"), "vec_id", "left_anti"))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """query_id, rank, vec_id and score, as search.nearest() gives them, from the probes lists nearest to each query; from all of them without a number,
        which is exact. Blocks of vectors and of queries meet by list, in matrix products, of which only the k best of each query leave."""
        centroids = self.centroids()
        asked = _nearest_lists(queries, "query_id", "query", centroids, len(centroids) if probes is None else probes)
        asked = _packed(asked, QUERIES).select("list", F.col("ids").alias("qids"), F.col("rows").alias("qrows"))
        pairs = self.blocks.read().join(asked, "list").select("ids", "rows", "qids", "qrows")

        def run(batches):
            for batch in batches:
                for v, vr, q, qr in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    vids, qids = np.array(v, np.int64), np.array(q, np.int64)
                    cols = _best(vids, np.frombuffer(vr).reshape(len(vids), -1), qids, np.frombuffer(qr).reshape(len(qids), -1), k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

        found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        return top(found, "query_id", k, F.desc("score"), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")

    def recall(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> float:
        """The share of the k nearest of queries, by exhaustive search over the vectors indexed, that a search with so many probes finds."""
        exact = materialise(nearest(self.vectors.read(), queries, k), "exact").select("query_id", "vec_id")
        n = exact.count()
        return exact.join(self.search(queries, k, probes).select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0

    def probes_for(self, queries: DataFrame, k: int = 10, least: float = 0.95) -> int:
        """The number of probes, doubled from one on, that reaches a recall of at least that on a sample of queries; all lists, which are exact, if none does."""
        lists, probes = len(self.centroids()), 1
        while probes < lists and self.recall(queries, k, probes) < least:
            probes *= 2
        return min(probes, lists)
