import datetime as dt
import json

from pyspark.sql import functions as F

from quillstone.operators import review
from quillstone.sources import files as S
from quillstone.sources.snapshots import Pointer, Table
from quillstone.streaming import jobs as J

AT = dt.datetime(2024, 1, 1)
KIND = "event_id bigint, ip string, ts timestamp"


def _run(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_stream_of_the_limiter_equals_its_batch(spark, tmp_path):
    rows = [(i, f"k{i % 3}" if i % 2 else None, AT + dt.timedelta(seconds=i * 2)) for i in range(120)]
    limits = ((3, 30), (8, 200))
    table = spark.createDataFrame(rows, KIND)
    for i, part in enumerate((rows[:50], rows[50:])):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    got = _run(J.limited_stream(stream, "ip", "ts", "event_id", limits), tmp_path, "limited", "append")
    want = review.limited(table, "ip", "ts", "event_id", limits)
    assert sorted((r.event, r.accepted) for r in got.collect()) == sorted((r.event_id, r.accepted) for r in want.collect())


def test_the_limiter_forgets_idle_keys(spark, tmp_path):
    """A thousand keys that come once, then one key for a long time: in the end its state alone is left, and it is judged as in a batch."""
    day = [(i, f"once-{i}", AT + dt.timedelta(seconds=i)) for i in range(1000)]
    parts = [day, *[[(2000 + 10 * b + i, "stays", AT + dt.timedelta(hours=3 * b, seconds=i)) for i in range(10)] for b in range(1, 5)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = J.limited_stream(stream, "ip", "ts", "event_id", ((3, 30), (8, 200)), "10 minutes")
    q = out.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", f"{tmp_path}/c-idle").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    want = review.limited(spark.createDataFrame([r for p in parts for r in p], KIND), "ip", "ts", "event_id", ((3, 30), (8, 200)))
    assert sorted((r.event, r.accepted) for r in spark.table("idle").collect()) == sorted((r.event_id, r.accepted) for r in want.collect())


def test_windows_counters_and_dedup(spark, tmp_path):
    rows = [(i, f"k{i % 2}", AT + dt.timedelta(minutes=i * 7)) for i in range(30)] + [(99, "k0", AT + dt.timedelta(days=1))]
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
    hours = _run(J.tumbling(read(), "ts", "1 hour", "5 minutes", "ip"), tmp_path, "hours", "append")
    want = {}
    for _, k, t in rows[:-1]:
        want[t.replace(minute=0), k] = want.get((t.replace(minute=0), k), 0) + 1
    assert {(r.window_start, r.ip): r.n for r in hours.collect()} == want
    slides = J.sliding(spark.createDataFrame(rows, KIND), "ts", "2 hours", "1 hour", "5 minutes")
    assert slides.agg(F.sum("n")).first()[0] == 2 * len(rows)
    assert J.sessions(spark.createDataFrame(rows, KIND), "ts", "30 minutes", "5 minutes", "ip").count() == 3
    assert {r.ip for r in _run(J.first_seen(read(), ["ip"], "ts", "1 hour"), tmp_path, "firsts", "append").collect()} == {"k0", "k1"}
    calls = read().select(F.col("ip").alias("model"), F.lit(2).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    assert {r.model: (r.n_requests, r.input_tokens) for r in _run(J.usage(calls), tmp_path, "usage", "complete").collect()} == {"k0": (16, 32), "k1": (15, 30)}
    assert J.live(spark.createDataFrame(rows, KIND), "ts", F.lit(AT + dt.timedelta(days=1)), 3600).count() == 1


def test_files_set_off_jobs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"url": "u", "content": "c"}), encoding="utf-8")
    seen = []

    def job(rows, batch):
        seen.append((batch, rows.count()))

    stream = lambda: spark.readStream.schema("url string, content string").json(str(folder))
    J.on_files(stream(), job, f"{tmp_path}/c", "one").awaitTermination(60)
    (folder / "b.json").write_text(json.dumps({"url": "v", "content": "d"}), encoding="utf-8")
    J.on_files(stream(), job, f"{tmp_path}/c", "two").awaitTermination(60)
    J.on_files(stream(), job, f"{tmp_path}/c", "three").awaitTermination(60)
    assert seen == [(0, 1), (1, 1)]
    rows, bad = spark.read.json(str(folder)), spark.createDataFrame([("ERROR",)], "severity string")
    assert J.judged_output(rows, bad, f"{tmp_path}/good", f"{tmp_path}/rejected").endswith("rejected")
    assert J.judged_output(rows, bad, f"{tmp_path}/good", f"{tmp_path}/rejected", blocking=False).endswith("good")


TEXT = "A sentence that is long enough to make a chunk of a page of its own. " * 3
PAGES = "source_url string, dropdown_url string, dropdown_title string, title string, content string, content_hash string, video_url string"


def _crawl(spark, *pages):
    return spark.createDataFrame([(f"https://p/{u}", "", "", None, f"{TEXT}{c}", c, "") for u, c in pages], PAGES)


def _indexed(spark, tmp_path):
    return S.create_index(spark, f"{tmp_path}/index"), Pointer(spark, f"{tmp_path}/runs")


def _state(index):
    return {(r.source_url, r.content[-1], r.refresh_count) for r in index.read().collect()}


def test_index_job(spark, tmp_path):
    index, runs = _indexed(spark, tmp_path)
    job = J.index_job(index, runs, "own.org", f"{tmp_path}/old", embed=lambda df: df.withColumn("embedding", F.array(F.lit(0.5).cast("float"))))
    whole = [(i, "a") for i in range(8)]
    job(_crawl(spark, *whole), 0)
    assert len(_state(index)) == 8 and index.read().filter("embedding IS NULL").count() == 0
    job(_crawl(spark, *whole[:7], (9, "b")), 1)
    assert {u for u, _, _ in _state(index)} == {f"https://p/{i}" for i in (*range(7), 9)} and spark.read.json(f"{tmp_path}/old/run=index-1").count() == 1
    before = index.version()
    job(_crawl(spark, (9, "z")), 1)  # comes again
    job(_crawl(spark, (9, "b")), 2)  # most pages would vanish
    job(_crawl(spark), 3)
    assert index.version() == before and [e["value"]["outcome"] for e in runs.history()] == ["committed", "committed", "too many pages would vanish", "no usable page"]


def test_a_job_that_fails_between_commit_and_note(spark, tmp_path, monkeypatch):
    index, runs = _indexed(spark, tmp_path)
    job = J.index_job(index, runs, "own.org")
    with monkeypatch.context() as m:
        m.setattr(Pointer, "move", lambda self, *a, move=Pointer.move, **k: move(self, *a, **k) if self is index else 1 / 0)
        try:
            job(_crawl(spark, (1, "a")), 0)
        except ZeroDivisionError:
            pass
    assert index.version() == 2 and runs.version() == 0
    job(_crawl(spark, (1, "b"), (2, "b")), 0)
    assert index.version() == 2 and runs.value() == {"batch": "index-0", "outcome": "committed", "version": 2}


def test_freshness_job(spark, tmp_path):
    index, runs = _indexed(spark, tmp_path)
    J.index_job(index, runs, "own.org")(_crawl(spark, *[(i, "a") for i in range(6)]), 0)
    index.write(index.read().withColumn("content_hash", F.lit("a")))
    approved = spark.createDataFrame([(f"https://p/{i}",) for i in range(8)], "url string")
    health = spark.createDataFrame([(f"https://p/{i}", "dead_404" if i == 0 else "ok") for i in range(8)], "url string, status string")
    job = J.freshness_job(index, runs, approved, health, "own.org", f"{tmp_path}/old")
    job(_crawl(spark, (1, "b"), (2, "a"), (7, "n")), 0)
    assert _state(index) == {(f"https://p/{i}", "a", None) for i in range(2, 6)} | {("https://p/1", "b", 1), ("https://p/7", "n", 0)}
    dead = spark.createDataFrame([(f"https://p/{i}", "dead_404") for i in range(8)], "url string, status string")
    J.freshness_job(index, runs, approved, dead, "own.org")(_crawl(spark, (1, "c")), 1)
    assert runs.value()["outcome"] == "too many pages would be removed" and len(_state(index)) == 6


def test_answers_job(spark, tmp_path):
    index, runs = Table(spark, f"{tmp_path}/answers"), Pointer(spark, f"{tmp_path}/runs")
    index.write(spark.createDataFrame([], "entry_id string, question string, answer string, intent string, scenario string"))
    sheet = lambda *rows: spark.createDataFrame(rows, "_row int, id string, question string, answer string, advice_boundary string")
    job = J.answers_job(index, runs, ["ok.org"])
    job(sheet((2, "a", "One?", "1", "true"), (3, "b", "Two?", "2", "true")), 0)
    job(sheet((2, "a", "One?", "one", "true")), 1)
    job(sheet((2, "a", "", "x", "true")), 2)
    assert [tuple(r)[:3] for r in index.read().collect()] == [("a", "One?", "one")] and runs.value()["outcome"] == "1 rows with errors"
