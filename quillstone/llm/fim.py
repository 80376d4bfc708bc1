"""Fill-in-middle transformation by succinct rank and select.

The texts of a slice of documents lie in one buffer. Two bitvectors mark its bytes: where a token starts, and where a code point
starts. Each is packed into 64-bit words, with a directory of the ones before each block of words. A difference of two ranks is the
number of tokens of a document, its total popcount; two selects give the bytes where prefix and middle end; ranks of the second vector
tell their code points. No list of tokens is ever made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table, whole

#: Markers of prefix, suffix and middle; a text that contains one stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
SEED = 1
_WORDS = 8  # words of a block of the directory
_SLICE = 4 << 20  # bytes of text in a slice; a longer text is one by itself

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Bits:
    """A bitvector with rank and select by blocks: constant and logarithmic time for a question, and questions come as arrays."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        words = np.zeros(-(-len(raw) // (8 * _WORDS)) * _WORDS + _WORDS, np.uint64)
        words.view(np.uint8)[: len(raw)] = raw
        self.words = words
        ones = np.bitwise_count(words).astype(np.int64).reshape(-1, _WORDS)
        self.inner = np.cumsum(ones, axis=1) - ones  # ones of the block before each word
        self.before = np.concatenate([[0], np.cumsum(ones.sum(axis=1))])  # ones before each block

    def __len__(self) -> int:
        """All ones."""
        return int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word // _WORDS] + self.inner[word // _WORDS, word % _WORDS] + np.bitwise_count(low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one before which there are k others."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        word = (self.inner[block] <= left[:, None]).sum(axis=1) - 1
        left = left - self.inner[block, word]
        bits = np.unpackbits(self.words[block * _WORDS + word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (block * _WORDS + word) * 64 + (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)


def draws(doc_id, seed: int = SEED) -> list[int]:
    """h1 to h4 of a document; a null id counts as the empty string."""
    said = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(said[i : i + 8], 16) for i in range(0, 32, 8)]


def cuts(texts: list[bytes], hs: list[list[int]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """For each text its number of tokens, the bytes where prefix and middle end, and the code points of both: arrays of two columns."""
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    letter, lead = _LETTER[raw], (raw & 0xC0) != 0x80
    first = lead.copy()
    first[1:] &= ~(letter[1:] & letter[:-1])
    first[starts[starts < ends]] = True
    tokens, points = Bits(first), Bits(lead)
    low = tokens.rank(starts)
    n = tokens.rank(ends) - low
    h = np.array(hs, np.int64)
    units = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = np.repeat(ends[:, None], 2, axis=1)
    inside = units < n[:, None]
    at[inside] = tokens.select((low[:, None] + units)[inside])
    chars = np.diff(points.rank(np.concatenate([starts[:, None], at], axis=1).ravel()).reshape(-1, 3), axis=1)
    return n.tolist(), at - starts[:, None], chars


def restore(output: bytes, form: str) -> bytes:
    """The text from which a document of that form was made. A piece of text holds no marker, and none can arise where a piece meets a
    marker, since only its first byte is `<`."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    i = output.index(second)
    j = output.index(MIDDLE, i)
    one, two, middle = output[len(first) : i], output[i + len(second) : j], output[j + len(MIDDLE) :]
    return two + middle + one if form == "spm" else one + middle + two


def rewrite(texts: list[bytes], ids: list, seed: int = SEED):
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    hs = [draws(i, seed) for i in ids]
    for text, h, n, (i, j), (p, m) in zip(texts, hs, *(x if isinstance(x, list) else x.tolist() for x in cuts(texts, hs)), strict=True):
        if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= PLAIN_FROM:
            yield n, "plain", None, None, text
        elif h[3] % 100 < SPM_BELOW:
            yield n, "spm", p, m, SUFFIX + text[j:] + PREFIX + text[:i] + MIDDLE + text[i:j]
        else:
            yield n, "psm", p, m, PREFIX + text[:i] + SUFFIX + text[j:] + MIDDLE + text[i:j]


def _slices(batches, limit: int):
    """(ids, texts as bytes) of some documents at a time, at most `limit` bytes of text unless one alone has more."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            if texts and size + len(raw) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(raw)
            size += len(raw)
        if texts:
            yield ids, texts


def _made(docs: DataFrame, fields: list[tuple], columns_of, seed: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    names = ["doc_id", *(f[0] for f in fields)]

    def run(batches):
        for batch in batches:
            for ids, texts in _slices([batch], _SLICE):
                rows = [columns_of(r) for r in rewrite(texts, ids, seed)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array([r[i] for r in rows], f[1]) for i, f in enumerate(fields))], names)

    spec = ", ".join([f"doc_id {kind.simpleString()}", *(f"{f[0]} {f[2]}" for f in fields)])
    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(run, spec)


_HEAD = [("n", pa.int64(), "bigint"), ("form", pa.string(), "string"), ("prefix_chars", pa.int64(), "bigint"), ("middle_chars", pa.int64(), "bigint")]


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and output (the rewritten text) of each row of docs (doc_id, text).

    Every row is rewritten by itself, whole; equal rows give equal rows. A null text counts as empty: n is 0, the form plain. A null id
    draws as an empty one. Other columns are not carried, whatever their names. An empty table gives an empty result.
    """
    return _made(docs, [*_HEAD, ("output", pa.string(), "string")], lambda r: (*r[:4], r[4].decode()), seed)


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """As transform, with the SHA-256 of the output and of the text restored from it in the place of the output; made in the workers, so
    that texts don't travel. Nulls, empty and repeated rows, extra columns and an empty table: as there."""

    def columns_of(r):
        n, form, p, m, out = r
        return n, form, p, m, hashlib.sha256(out).hexdigest(), hashlib.sha256(restore(out, form)).hexdigest()

    return _made(docs, [*_HEAD, ("output_sha256", pa.string(), "string"), ("restored_sha256", pa.string(), "string")], columns_of, seed)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
h AS (SELECT *, len(w)::BIGINT AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
             ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1:i], '') AS a, array_to_string(w[i + 1:j], '') AS b, array_to_string(w[j + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
