"""LM scoring by cross-entropy difference.

Two bigram models, one of the target (documents labelled good) and one of the
background (all documents), are matched in order, smoothing and vocabulary: all words
of the background, and one place for the unknown. A document's score is its loss a
token under the target less that under the background: lower is more like the target.

The models are a table of the counts of all words and word pairs, by hashes of 63
bits; nothing of them is broadcast or collected but three totals, and they grow with the
corpus. Documents are packed into chunks; a chunk sends the counts of what its documents
hold, once a word or pair, to buckets of hashes, and is told the sums (chunks.tally, in
two levels beyond chunks.MOST buckets), so that a common word is one entry of a chunk,
and of a group of chunks.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .chunks import batch_of, chunks, inflate, pack, unpack
from .common import materialise, shuffle_partitions, table

#: What the unigram model adds to each count; how many counts the unigram model is worth to a bigram.
ADD, PRIOR = 0.5, 20.0
#: Bytes of text that a bucket stands for.
BUCKET = 32 << 20
#: Bits of a hash.
BITS = 63
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = re.compile(r"\s")


@dataclass
class Models:
    """counted: what each chunk of the background holds (chunk < 0, bucket, counts: hashes, and how often they occur in it and in its
    documents of the target); words have even hashes, pairs odd ones."""

    counted: DataFrame
    n_buckets: int
    parts: int


def words_of(text: str, piece: int = 1 << 20):
    """Lists of the lower-case words of text, a piece at a time: what a very long text takes beside itself is bounded."""
    low, begin = text.lower(), 0
    while begin < len(low):
        blank = _BLANK.search(low, begin + piece) if len(low) - begin > piece else None
        end = blank.start() if blank else len(low)
        yield low[begin:end].split()
        begin = end


class _Chunk:
    """The tokens of a chunk's documents, and its words and pairs by hash."""

    def __init__(self, docs: bytes, texts: bytes, n_buckets: int):
        self.has, self.ids, self.lengths = unpack(docs, 3)
        raw, seen, tokens, self.n_tokens, end = inflate(texts), {}, [], [], 0
        for k in self.lengths.tolist():
            before = len(tokens)
            for found in words_of(raw[end : end + k].decode("utf-8")):
                tokens += [seen.setdefault(w, len(seen)) for w in found]
            self.n_tokens.append(len(tokens) - before)
            end += k
        self.tokens, n = np.array(tokens, np.int64), len(seen)
        self.owner = np.repeat(np.arange(len(self.lengths)), self.n_tokens)
        self.second = np.flatnonzero(self.owner[1:] == self.owner[:-1]) + 1
        pairs, self.pair = np.unique(self.tokens[self.second - 1] * n + self.tokens[self.second], return_inverse=True)
        words = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in seen), np.uint64)
        h = (words[pairs // max(1, n)] * _A) ^ (words[pairs % max(1, n)] + _B)
        h = (h ^ (h >> np.uint64(31))) * _B
        h ^= h >> np.uint64(29)
        one = np.uint64(1)
        keys = np.concatenate([(words >> one) & ~one, (h >> one) | one]).astype(np.int64)
        self.n_words, self.order = n, np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.cuts = C.cuts(self.keys, n_buckets, BITS)

    def counts(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key occurs, and how often in flagged documents."""
        out = []
        for weight in (np.ones(len(flags)), flags.astype(float)):
            w = weight[self.owner]
            both = np.concatenate([np.bincount(self.tokens, w, self.n_words), np.bincount(self.pair, w[self.second], len(self.keys) - self.n_words)])
            out.append(both.astype(np.int64)[self.order])
        return out[0], out[1]

    def slices(self):
        return ((b, i, j) for b, (i, j) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)) if j > i)

    def losses(self, found: np.ndarray, models: tuple) -> list[np.ndarray]:
        """The loss of each document in nats a token, under the background and the target; found: the counts of the keys in both."""
        n_words, *totals = models
        counts = np.empty_like(found)
        counts[:, self.order] = found
        out = []
        for c, total in zip(counts, totals, strict=True):
            alone = ((c[: self.n_words] + ADD) / (total + ADD * (n_words + 1)))[self.tokens]
            p = alone.copy()
            p[self.second] = (c[self.n_words :][self.pair] + PRIOR * alone[self.second]) / (c[: self.n_words][self.tokens[self.second - 1]] + PRIOR)
            out.append(np.bincount(self.owner, -np.log(p), len(self.lengths)) / np.maximum(1, self.n_tokens))
        return out


def _totals(keys: np.ndarray, sums: list[np.ndarray]) -> list[int]:
    """Words of the background, their occurrences, and those in the target."""
    word = (keys % 2 == 0) & (sums[0] > 0)
    return [int(word.sum()), int(sums[0][word].sum()), int(sums[1][word].sum())]


def _tally(asked: DataFrame, n_buckets: int, parts: int) -> tuple[DataFrame, tuple[int, int, int]]:
    told, totals = C.tally(asked, 2, n_buckets, parts, BITS, _totals, lambda sums: pack(*sums), "lm-told")
    return told, tuple(totals or (0, 0, 0))


def _asked(packed: DataFrame, n_buckets: int) -> DataFrame:
    """The hashes of each chunk, by bucket, with counts of 0."""

    def run(batches):
        for batch in batches:
            for c, docs, texts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                chunk = _Chunk(docs, texts, n_buckets)
                yield batch_of(C.ASKED, [(c, b, pack(np.diff(chunk.keys[i:j], prepend=0), *[np.zeros(j - i)] * 2)) for b, i, j in chunk.slices()])

    return packed.select("chunk", "docs", "texts").mapInArrow(run, C.ASKED_SQL)


def _counted(packed: DataFrame, target: DataFrame, n_buckets: int) -> DataFrame:
    """The hashes of each chunk and their counts, by bucket. Only ids meet those of the target, whatever its size."""

    def ids(batches):
        for batch in batches:
            for c, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                has, doc_ids, _ = unpack(docs, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(has.sum()), c)), pa.array(doc_ids[has == 1])], ["chunk", "doc_id"])

    def run(key, mine, flagged):
        rows, good = [], flagged.column("doc_id").to_numpy()
        for c, docs, texts in zip(*(mine.column(x).to_pylist() for x in ("chunk", "docs", "texts")), strict=True):
            chunk = _Chunk(docs, texts, n_buckets)
            n, t = chunk.counts((chunk.has == 1) & np.isin(chunk.ids, good))
            rows += [(c, b, pack(np.diff(chunk.keys[i:j], prepend=0), n[i:j], t[i:j])) for b, i, j in chunk.slices()]
        return pa.Table.from_batches([batch_of(C.ASKED, rows)])

    flagged = packed.select("chunk", "docs").mapInArrow(ids, "chunk bigint, doc_id bigint").join(target.select(F.col("doc_id").cast("long")), "doc_id", "left_semi")
    return packed.groupBy("chunk").cogroup(flagged.groupBy("chunk")).applyInArrow(run, C.ASKED_SQL)


def _buckets(packed: DataFrame, most: int) -> tuple[int, int]:
    total = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).head()[0]
    return C.levels(max(shuffle_partitions(packed.sparkSession), -(-total // BUCKET)), most)


def fit(docs: DataFrame, target: DataFrame, most: int = C.MOST, chunk: int = C.CHUNK) -> Models:
    """docs: (doc_id: a whole number, text); target: the doc_id of the target's documents. A null text is empty; a row with a null id
    is none of the target. most: the buckets that a chunk of so many bytes sends to at once."""
    packed = chunks(docs, "lm-chunks", chunk)
    n_buckets, parts = _buckets(packed, most)
    counted = _counted(packed, target, n_buckets).withColumn("chunk", -1 - F.col("chunk"))
    return Models(materialise(counted, "lm-counted"), n_buckets, parts)


def score(docs: DataFrame, models: Models, chunk: int = C.CHUNK) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score (their difference) of docs (doc_id: a whole number, text). A text
    without words, or null, has no tokens and scores 0. Repeated rows, and rows with a null id, score alike; other columns are not
    carried, whatever their names; an empty table gives an empty result."""
    packed = chunks(docs, "lm-chunks", chunk)
    told, totals = _tally(models.counted.unionByName(_asked(packed, models.n_buckets)), models.n_buckets, models.parts)
    return _scored(packed, told.filter("chunk >= 0"), models.n_buckets, totals)


def fit_and_score(docs: DataFrame, target: DataFrame, most: int = C.MOST, chunk: int = C.CHUNK) -> DataFrame:
    """score(docs, fit(docs, target)), with hashes and counts moved once."""
    packed = chunks(docs, "lm-chunks", chunk)
    n_buckets, parts = _buckets(packed, most)
    told, totals = _tally(_counted(packed, target, n_buckets), n_buckets, parts)
    return _scored(packed, told, n_buckets, totals)


def _scored(packed: DataFrame, told: DataFrame, n_buckets: int, totals: tuple[int, int, int]) -> DataFrame:
    def run(key, mine, told_):
        rows = []
        said = list(zip(told_.column("bucket").to_pylist(), told_.column("counts").to_pylist(), strict=True))
        for docs_, texts in zip(mine.column("docs").to_pylist(), mine.column("texts").to_pylist(), strict=True):
            chunk = _Chunk(docs_, texts, n_buckets)
            found = np.zeros((2, len(chunk.keys)), np.int64)
            for b, blob in said:
                found[:, chunk.cuts[b] : chunk.cuts[b + 1]] = unpack(blob, 2)
            background, target = chunk.losses(found, totals)
            ids = [d if has else None for has, d in zip(chunk.has.tolist(), chunk.ids.tolist(), strict=True)]
            rows += zip(ids, chunk.n_tokens, target.tolist(), background.tolist(), (target - background).tolist(), strict=True)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.Table.from_batches([batch_of(dict(zip(("doc_id", "n_tokens", "target_loss", "background_loss", "score"), kinds, strict=True)), rows)])

    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return fit_and_score(docs, good)
