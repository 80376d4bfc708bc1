"""Jobs that are to be done whole, at every size."""

import json
import math

from quillstone.llm import bpe, langid

DATA = "/root/testdata/sf0.001"


def test_small_tables_calibrate_the_limit(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs)
    assert all(map(math.isfinite, model.limits))
    odd = spark.createDataFrame([(1, "これは未知の文字です " * 20), (2, "xqzjv kwqxz zzqjx vxkqj " * 20)], "doc_id bigint, text string")
    assert {r.rejected for r in langid.predict(odd, model).collect()} == {True}
    two = docs.filter("lang = 'en'").limit(2)
    assert all(map(math.isfinite, langid.fit(two).limits)) and set(langid.fit(docs.limit(1)).limits) == {math.inf}


def test_decoded_text_is_made_from_ids(spark, tmp_path):
    with open(bpe.vocabulary_path(), encoding="utf-8") as f:
        spec = json.load(f)
    wrong = spec["model"]["vocab"]["the</w>"]
    spec["added_tokens"].append({"content": "<|wrong|>", "id": wrong})  # the id of "the" now means something else
    path = tmp_path / "vocabulary.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    docs = spark.createDataFrame([(1, "the")], "doc_id int, text string")
    assert bpe.encode_docs(docs, str(path)).head().decoded == "<|wrong|>"
    assert bpe.digests(docs, str(path)).head().decoded_sha256 == bpe.hashlib.sha256(b"<|wrong|>").hexdigest()
