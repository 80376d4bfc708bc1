"""The index of vectors against exhaustive search; sets of queries and caches beyond what a worker holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import search, serving
from quillstone.operators.vector_index import VectorIndex

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").cache()


def queries(vectors, every=100):
    return vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_all_lists_are_exact_and_few_find_most(spark, vectors, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/index").build(vectors)
    asked = queries(vectors)
    assert rows(index.search(asked)) == rows(search.nearest(vectors, asked)) and index.vectors.read().count() == vectors.count()
    probes = index.probes_for(asked, 10, 0.95)
    assert 1 <= probes <= len(index.centroids()) and index.recall(asked, 10, probes) >= 0.95
    other = vectors.filter("vec_id % 100 = 37").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert index.recall(other, 10, probes) >= 0.9  # queries on which the number was not measured


def test_changes(spark, vectors, tmp_path):
    index = VectorIndex(spark, f"{tmp_path}/index").build(vectors.filter("vec_id < 400"), lists=7, sample=100)
    more = vectors.filter("vec_id BETWEEN 350 AND 500").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index.upsert(more).delete(vectors.filter("vec_id < 20"))
    now = vectors.filter("vec_id BETWEEN 20 AND 349").unionByName(more)
    assert rows(index.search(queries(vectors, 50))) == rows(search.nearest(now, queries(vectors, 50))) and len(index.centroids()) == 7 and index.vectors.version() == 3


def test_odd_vectors(spark, tmp_path):
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (3, None), (4, []), (5, [1.0, 0.1]), (5, [0.0, 1.0])], "vec_id long, embedding array<double>")
    index = VectorIndex(spark, f"{tmp_path}/index").build(odd, lists=2)
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, query array<double>")
    assert rows(index.search(asked, 3)) == rows(search.nearest(odd, asked, 3))
    empty = VectorIndex(spark, f"{tmp_path}/empty").build(odd.limit(0))
    assert empty.search(asked).count() == 0 and empty.upsert(odd).search(asked, 3).count() == 3


def test_a_cache_beyond_a_worker(spark, vectors):
    cache = vectors.filter("vec_id % 3 = 0").select(F.concat(F.lit("k"), F.lpad(F.col("vec_id").cast("string"), 6, "0")).alias("key"), "embedding")
    asked = vectors.filter("vec_id % 40 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    held, blocks = (sorted((r.query_id, r.key, round(r.similarity, 9)) for r in serving.nearest_cached(asked, cache, 0.2, held=n).collect()) for n in (50_000, 10))
    assert held == blocks and len(held) > 5


def test_items_beyond_a_worker(spark, monkeypatch):
    words = lambda name, key: spark.read.parquet(f"{DATA}/{name}.parquet").select(F.col(key).cast("long").alias(key), T.alnum_words(F.col("text")).alias("words"))
    docs, items = words("documents", "doc_id").limit(300), words("benchmark", "item_id")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("words", F.array().cast("array<string>")))
    found = lambda: sorted((r.doc_id, r.item_id, round(r.f1, 9), round(r.jaccard, 9)) for r in search.closest(docs, items).collect())
    ranked = lambda: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in search.bm25(docs, items.withColumnRenamed("item_id", "query_id"), 5).collect())
    docs = docs.cache()
    held = found()
    monkeypatch.setattr(search, "ASKED", 5)
    assert found() == held
    docs = words("documents", "doc_id").limit(300).cache()
    by_joins = ranked()
    monkeypatch.setattr(search, "ASKED", 20_000)
    assert ranked() == by_joins and np.isfinite([x[3] for x in by_joins]).all()


def test_scores_are_summed_in_one_order(spark):
    """So they don't depend on the blocks, and copies of a vector stay in the order of their ids."""
    m = np.random.default_rng(3).normal(2, size=(500, 64)).astype(np.float32)
    m[250:] = m[:250]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in search.nearest(df, queries(df, 5), 499).collect()}
    v, s, n = m.astype(float), np.zeros((500, 500)), np.zeros(500)
    for x in v.T:
        s, n = s + x[:, None] * x[None, :], n + x * x
    s = s / (np.sqrt(n)[:, None] * np.sqrt(n)[None, :])
    for q in range(0, 500, 5):
        score = np.sign(s[q]) * np.floor(np.abs(s[q]) * 1e12 + 0.5) / 1e12
        best = [i for i in sorted(range(500), key=lambda i: (-score[i], i)) if i != q]
        assert [got[q, k + 1] for k in range(499)] == [(i, score[i]) for i in best]


def test_diagnosis_equals_its_sql_where_the_reranker_moves_the_best(spark, tmp_path):
    import duckdb

    from quillstone.plans.searching import ORACLE_SQL, QUERIES

    near = {100: 0.0, 95: 0.1, **{i: 0.1 + i / 10 for i in range(1, 8)}}  # the page of 95 is the best, and the last of eight to the reranker
    at = lambda i: near.get(i, 2.0 + i / 1000)
    spark.createDataFrame([(i, [float(np.cos(at(i))), float(np.sin(at(i)))], 0) for i in range(101)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "b"), (1, "c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["search_diagnosis"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['search_diagnosis']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert (100, "healthy", 1, 1, None, 8) in want
