"""Small tables against brute force, with nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import hashlib
import re
import struct

import duckdb
import pytest

from quillstone.llm import bpe, fingerprint, jaccard_join, langid, lm_scoring, mixing, pii, quality, suffix_dedup, url_filter

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " \t\n", "one", "the same line of words here\n" * 40, "x" * 5000, "a b c d e f g h " * 900, "The quick brown fox jumps over the lazy dog and runs far away from it all."]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 == 0 else f"s{i % 2}", "en", 1, 7) for i, t in enumerate([*ODD, ODD[-1], ODD[-1]])]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id bigint, text string, source string, lang string, n_chars bigint, size int")


def words(text):
    return re.findall(WORD, text or "")


@pytest.mark.parametrize("module, name", [(url_filter, "op1_url_filter"), (mixing, "op3_source_mixing"), (quality, "op9_quality_rules")])
def test_query_equals_its_sql(spark, module, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = getattr(module, name)(spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({module.ORACLE_SQL})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want))


def test_cascade_is_exact(spark):
    keys = spark.range(3000).selectExpr("concat('h', id, '/') AS key")
    c = url_filter.build_cascade(keys.filter("key LIKE '%7/'"), keys)
    assert keys.filter(c.contains(keys.key)).count() == 300
    assert keys.filter((c.contains(keys.key)) != (keys.key.endswith("7/"))).count() == 0


def test_odd_urls(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "HTTP://WWW.Example.COM/en/a?b", "x"), (4, "http://com", "x"), (5, "http://a.spam-farm.example.org/x", "x")], "page_id int, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert got == {1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 4: ("com", "", None, "allow"), 5: ("a.spam-farm.example.org", "/x", None, "block")}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_suffix_dedup(spark, odd):
    got = {r.doc_id: r for r in suffix_dedup.dedup(odd.select("doc_id", "text")).collect()}
    seen = set()
    for i, t in enumerate([*ODD, ODD[-1], ODD[-1]]):
        raw = (t or "").encode()
        gone, own = [0] * len(raw), set()
        for k in range(len(raw) - 49):
            own.add(raw[k : k + 50])
            if raw[k : k + 50] in seen:
                gone[k : k + 50] = [1] * 50
        seen |= own
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(raw), len(raw) - len(kept), hashlib.sha256(kept).hexdigest())


def test_blind_trie_sorts():
    strings = [b"abca", b"abcb", b"abca", b"aaaa", b"zzzz", b"abza", b"aaab"]
    assert [strings[i] for i in suffix_dedup.blind_trie(strings)] == sorted(strings)


def test_mixing(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and all(r.size == len(words(r.text)) and r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.repeated(odd).count() == sum(r.repeats for r in rows)


def test_lm_scoring(spark, odd):
    docs, good = odd, odd.filter("doc_id = 7")
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.fit(docs, good)).collect()}
    assert got[0].n_tokens == 0 and got[0].score == 0 and got[7].score < got[6].score
    assert lm_scoring.score(docs.limit(0), lm_scoring.fit(docs.limit(0), good)).count() == 0


def test_pii(spark):
    docs = spark.createDataFrame([(1, "é😀 a@b.c_d@e.f and 1.2.3.4 or 256.1.1.1", 0), (2, None, 0), (3, "call 555-123-4567 or +1 555 123 4567.", 0), (4, "4111 1111 1111 1111", 0), (5, "1" * 4000 + "a" * 9000, 0)], "doc_id int, text string, n_chars int")
    got = {r.doc_id: (r.b, r.s) for r in pii.find(docs).select("doc_id", pii.listed("_base").alias("b"), pii.listed("_spans").alias("s")).collect()}
    assert got[1][0] == "email:3:8,email:8:14,ip:19:26" and got[2] == ("", "") and got[3][0] == "phone:21:36" and got[4][0] == "card:0:19" and got[5] == ("", "")
    assert pii.masked(docs.limit(0)).count() == 0


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(bpe.vocabulary_path()), bpe.Codec(bpe.vocabulary_path())
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]
    for t in [*texts, *(t or "" for t in ODD), "Σας <|endoftext|>it's I'LL 12३ 😀", "İ ﬁ é ok"]:
        ids = library.encode(t, add_special_tokens=False).ids
        raw, said = codec.encode(t)
        assert raw == struct.pack(f"<{len(ids)}I", *ids) and said == library.decode(ids, skip_special_tokens=False) == codec.decode(raw)


def test_fingerprints(spark, odd):
    texts = sorted((r.doc_id, r.text or "") for r in odd.collect())
    got = sorted(fingerprint.fingerprints(odd, 3).collect(), key=lambda r: r.doc_id)
    for i, ((d, t), r) in enumerate(zip(texts, got, strict=True)):
        n = len(t) // 4
        edited = t[: len(t) - n] + texts[(i + 1) % len(texts)][1][:n]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d, len(t), hashlib.sha256(edited.encode()).hexdigest()) and 0 <= r.near_edited <= 1
    two = spark.createDataFrame([(1, "one\ntwo\nthree"), (2, "three\none\ntwo")], "doc_id int, text string")
    assert len({r.fingerprint for r in fingerprint.fingerprints(two).collect()}) == 1
    assert fingerprint.fingerprints(odd.limit(0)).count() == 0


def test_jaccard_join(spark):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, base, base.replace("w50", "x"), base.replace("w10 ", "y ").replace("w80 ", "z "), "a b", "a b", "", None, "other words entirely"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 2), 3: (0, 2), 4: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 0), 8: (8, 0)}
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_quality(odd):
    got = quality.apply_policy(quality.ledger(odd)).collect()
    assert len(got) == odd.count() and all(r.n_words == len(words(r.text)) for r in got) and not [r for r in got if r.n_words < 50 and not r.base_failed]
    assert quality.apply_policy(quality.ledger(odd)).filter("kept").count() == len([r for r in got if r.kept])


def test_language_id(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.op10_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    nothing = langid.predict(odd, langid.fit(docs)).filter("doc_id < 3").collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_lm_scoring_equals_plain_models(spark):
    from collections import Counter
    from math import log

    rows = [(1, "a b a b C", True), (2, "a c\tc d", False), (3, None, True), (4, "a b a b c", None), (5, "zz", False)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, is_target boolean")
    good = docs.filter("is_target")
    texts = [((t or "").lower().split(), bool(g)) for _, t, g in rows]
    vocabulary = {w for t, _ in texts for w in t}

    def loss(words, only):
        uni = Counter(w for t, g in texts if g or not only for w in t)
        bi = Counter(p for t, g in texts if g or not only for p in zip(t, t[1:], strict=False))
        alone = {w: (uni[w] + 0.5) / (uni.total() + 0.5 * (len(vocabulary) + 1)) for w in vocabulary}
        p = [alone[words[0]], *((bi[a, b] + 20 * alone[b]) / (uni[a] + 20) for a, b in zip(words, words[1:], strict=False))] if words else []
        return -sum(map(log, p)) / max(1, len(words))

    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.fit(docs, good)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got == {r.doc_id: r for r in lm_scoring.fit_and_score(docs, good).collect()}
    assert lm_scoring.fit_and_score(docs.limit(0), good).count() == 0
    for (i, *_), (words_, _) in zip(rows, texts, strict=True):
        assert got[i].n_tokens == len(words_)
        assert got[i].target_loss == pytest.approx(loss(words_, True)) and got[i].background_loss == pytest.approx(loss(words_, False))
        assert got[i].score == pytest.approx(got[i].target_loss - got[i].background_loss)
