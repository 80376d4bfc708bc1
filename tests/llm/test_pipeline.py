"""The corpus pipeline: each stage on a small table, held against brute force or the rule it follows."""

import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

pipeline = pytest.importorskip("corpus_pipeline")
from quillstone.llm import bpe, langid, pii  # noqa: E402

from .test_methods import _base, _joined  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in pipeline.STAGES:
        made = stage(spark, docs, DATA).cache()
        out.append((docs, made))
        docs = made
    return out


def test_stages_keep_the_columns(staged):
    columns = staged[0][0].columns
    assert [made.columns == columns for _, made in staged] == [True] * 4 + [False]
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "near duplicates", "personal data", "mixing", "encoding"]


def test_language_stage(staged):
    docs, made = staged[0]
    model = langid.fit(docs)
    want = {r.doc_id for r in docs.collect() if not model.judge(r.text or "")[3]}
    assert {r.doc_id for r in made.collect()} == want and len(want) > 0.9 * docs.count()


def test_near_duplicate_stage(staged):
    docs, made = staged[1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in made.collect()) == sorted({c for _, c, _ in _joined(rows)})


def test_personal_data_stage(staged):
    docs, made = staged[2]
    before, after = ({r.doc_id: r for r in d.collect()} for d in (docs, made))
    assert before.keys() == after.keys()
    for i, r in before.items():
        text = after[i].text
        assert after[i].n_chars == (None if text is None else len(text))
        if not _base(r.text) and "token" not in (r.text or ""):
            assert text == r.text or re.search(r"\[(secret|id|account|name|phone)\]", text)
        for span in filter(None, _base(r.text).split(",")):
            a, e = map(int, span.split(":")[1:])
            assert r.text[a:e] not in text or not re.search(re.escape(r.text[a:e]) + r"(?![0-9])", text)
    assert any(f"[{k}]" in (r.text or "") for k in pii.BASE for r in after.values())


def test_mixing_stage(staged):
    docs, made = staged[3]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, taken, times = {}, {}, {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + words(r.text)
    for r in made.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), [3, 1, 2] * 100, strict=False))
    target, open_, rest = {}, dict(size), 1.5 * sum(size.values())
    while open_:  # plain water-filling, a round at a time
        share = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * size[s]]
        target |= {s: 2 * size[s] for s in full} if full else share
        rest -= sum(2 * size[s] for s in full)
        open_ = {s: n for s, n in open_.items() if s not in full} if full else {}
    longest = max(words(r.text) for r in docs.collect())
    assert max(times.values()) <= 2
    assert all(abs(taken.get(s, 0) - target[s]) <= longest for s in size)


def test_encoding_stage(staged):
    docs, made = staged[4]
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = sorted((r.doc_id, b"".join(i.to_bytes(4, "little") for i in library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.doc_id, bytes(r.ids)) for r in made.collect()) == want


def test_the_run_is_the_stages(spark, staged):
    assert pipeline.run(spark, DATA).select("doc_id").exceptAll(staged[4][1].select("doc_id")).count() == 0


def test_odd_documents_pass_through(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " the and of to in it is " * 30, "en", None, 1), (3, " the and of to in it is " * 30, "en", None, 1), (None, "the and of to in " * 40, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("hubs", F.lit("x")).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} <= {3, None}
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_encoding_stage_fails_where_the_library_is_missing_and_decides(tmp_path):
    """In a session of its own, whose workers can't import the library: a text of assigned code points is encoded, another is an error."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "tokenizers.py").write_text("raise ImportError('not installed')\n")
    code = """
import corpus_pipeline
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
for c in (0xE9, 0xA7CB):
    docs = spark.createDataFrame([(1, f"a1{chr(c)}b", "en", "s")], "doc_id int, text string, lang string, source string")
    try:
        print("ids", len(corpus_pipeline.encoded(spark, docs, "").first().ids))
    except Exception as e:
        print("raised", "U+A7CB is not in" in str(e))
"""
    path = os.pathsep.join([str(tmp_path), str(Path(pipeline.__file__).parent), os.environ.get("PYTHONPATH", "")])
    done = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": path}, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    ids, raised = [line for line in done.stdout.splitlines() if line.startswith(("ids", "raised"))]
    assert ids.startswith("ids") and raised == "raised True"


MARKS = ["x\u0301\u0899y", "a1\U00011935\U00011930b", "e\u0301\u0323"]


def test_encoding_stage_composes_as_the_library_does(spark):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(MARKS)], "doc_id int, text string, lang string, source string")
    for r in pipeline.encoded(spark, docs, "").collect():
        ids = library.encode(MARKS[r.doc_id], add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_encoding_stage_fails_where_the_library_is_missing_and_composes(tmp_path):
    """In a session of its own, whose workers can't import the library: marks and pairs that its NFC may not know are an error."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "tokenizers.py").write_text("raise ImportError('not installed')\n")
    code = f"""
import corpus_pipeline
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
for t in {MARKS!a}:
    docs = spark.createDataFrame([(1, t, "en", "s")], "doc_id int, text string, lang string, source string")
    try:
        print("ids", len(corpus_pipeline.encoded(spark, docs, "").first().ids))
    except Exception as e:
        print("raised", [c for c in ("U+0899", "U+11935") if c + " is not in" in str(e)])
"""
    path = os.pathsep.join([str(tmp_path), str(Path(pipeline.__file__).parent), os.environ.get("PYTHONPATH", "")])
    done = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": path}, cwd=tmp_path, capture_output=True, text=True, timeout=200)
    mark, pair, plain = [line for line in done.stdout.splitlines() if line.startswith(("ids", "raised"))]
    assert mark == "raised ['U+0899']" and pair == "raised ['U+11935']" and plain.startswith("ids")
