"""Documents packed into compressed chunks, and arrays packed for a shuffle.

An operator that asks the whole corpus about many small keys asks by chunk: what its
documents have in common is sent once, as sorted arrays, and the answers come back as
arrays in the same order. `tally` is that question: it adds up counts by key over all
chunks and tells every chunk the sums of its own keys. Beyond MOST buckets it adds up
in two levels, so that neither the rows that a chunk sends nor the chunks that meet in
one task grow with the corpus by more than its square root.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole

CHUNK = 4 << 20
#: Buckets to which a chunk sends its keys; with more, they are dealt out in two levels.
MOST = 2048


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers by planes of their bytes, compressed."""
    raw = b"".join(a.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(inflate(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(a.T).reshape(-1).view(np.int64) for a in raw]


def deflate(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def inflate(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.Codec("zstd").decompress(blob[8:], size, asbytes=True) if size else b""


def batch_of(schema: dict, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.values())], list(schema))


def ranges(n: np.ndarray) -> np.ndarray:
    """0 to n[0] - 1, 0 to n[1] - 1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


_CHUNKS = {"chunk": pa.int64(), "n_bytes": pa.int64(), "docs": pa.binary(), "texts": pa.binary()}


def chunks(docs: DataFrame, tag: str, size_of: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) packed and written: (chunk, n_bytes, docs: has an id, id and length of each document, by id, texts).
    A document of more than size_of bytes is a chunk by itself. Ids are taken as bigint."""

    def run(batches):
        rows, size, number = [], 0, TaskContext.get().partitionId() << 32

        def packed():
            rows.sort(key=lambda r: (r[0] is None, r[0]))
            heads = [np.array(x, np.int64) for x in ([r[0] is not None for r in rows], [r[0] or 0 for r in rows], [len(r[1]) for r in rows])]
            return batch_of(_CHUNKS, [(number, size, pack(*heads), deflate(b"".join(r[1] for r in rows)))])

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = t.as_buffer().to_pybytes()
                if rows and size + len(raw) > size_of:
                    yield packed()
                    rows, size, number = [], 0, number + 1
                rows.append((d, raw))
                size += len(raw)
        if rows:
            yield packed()

    docs = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"))
    return materialise(docs.mapInArrow(run, "chunk bigint, n_bytes bigint, docs binary, texts binary"), tag)


ASKED = {"chunk": pa.int64(), "bucket": pa.int64(), "counts": pa.binary()}
ASKED_SQL = "chunk bigint, bucket bigint, counts binary"


def levels(n_buckets: int, most: int = MOST) -> tuple[int, int]:
    """The buckets that a chunk sends to, and the parts into which each is dealt on the second level."""
    parts = -(-n_buckets // most)
    return -(-n_buckets // parts), parts


def cuts(keys: np.ndarray, n: int, bits: int, low: int = 0, of: int = 1) -> list[int]:
    """Where sorted keys of so many bits part into n ranges of their values (of range low of `of` equal ranges)."""
    edges = [((low * n + b) << bits) // (n * of) for b in range(1, n)]
    return [0, *np.searchsorted(keys, np.array(edges, np.int64)).tolist(), len(keys)]


def _summed(blobs: list[bytes], n: int):
    """The distinct keys of packed rows (differences of sorted keys, then n counts), the sums of their counts, and for each row
    the places of its keys."""
    rows = [unpack(b, n + 1) for b in blobs]
    sizes = [len(r[0]) for r in rows]
    keys, at = np.unique(np.concatenate([np.cumsum(r[0]) for r in rows]), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([r[i] for r in rows]), len(keys)).astype(np.int64) for i in range(1, n + 1)]
    ends = np.cumsum(sizes).tolist()
    return keys, sums, [at[a:e] for a, e in zip([0, *ends], ends, strict=False)]


def tally(asked: DataFrame, n_counts: int, n_buckets: int, parts: int, bits: int, facts, reply, tag: str) -> tuple[DataFrame, list[int]]:
    """asked: (chunk, bucket, counts: packed differences of sorted keys, then n_counts counts of each), a row for each chunk and
    bucket that it has keys of; buckets are n_buckets ranges of keys of so many bits. Returns (chunk, bucket, counts: reply(sums of
    the row's keys)), and the sums over all keys of facts(keys, sums), a list of whole numbers.

    With parts > 1, chunks are dealt by number to as many groups, which add up their own first; the sums of the groups then meet by
    parts of a bucket's range. Nothing depends on the order of rows, so a lost task is simply run again."""

    def told(rows, blobs, said):
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "counts": pa.array(blobs, pa.binary()), "facts": pa.array(said, pa.list_(pa.int64()))})

    def at_once(key, rows):
        keys, sums, at = _summed(rows.column("counts").to_pylist(), n_counts)
        return told(rows, [reply([s[a] for s in sums]) for a in at], [facts(keys, sums), *[None] * (len(at) - 1)])

    kind = f"{ASKED_SQL}, facts array<bigint>"
    if parts == 1:
        out = materialise(asked.groupBy("bucket").applyInArrow(at_once, kind), tag)
        said = out
    else:
        dealt = asked.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(parts)))
        dealt = materialise(dealt, f"{tag}-asked")

        def first(key, rows):
            keys, sums, _ = _summed(rows.column("counts").to_pylist(), n_counts)
            bucket, salt = key[0].as_py(), key[1].as_py()
            edges = cuts(keys, parts, bits, bucket, n_buckets)
            made = [(salt, bucket * parts + p, pack(np.diff(keys[i:j], prepend=0), *(s[i:j] for s in sums))) for p, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]
            return pa.Table.from_batches([batch_of(ASKED, made)])

        def second(key, rows):
            keys, sums, at = _summed(rows.column("counts").to_pylist(), n_counts)
            return told(rows, [pack(*(s[a] for s in sums)) for a in at], [facts(keys, sums), *[None] * (len(at) - 1)])

        def last(key, rows, sums_):
            if not rows.num_rows:
                return told(rows, [], [])
            _, _, at = _summed(rows.column("counts").to_pylist(), n_counts)
            sums_ = sums_.sort_by("part")
            sums = [np.concatenate(x) for x in zip(*(unpack(b, n_counts) for b in sums_.column("sums").to_pylist()), strict=True)]
            return told(rows, [reply([s[a] for s in sums]) for a in at], [None] * len(at))

        firsts = dealt.groupBy("bucket", "salt").applyInArrow(first, ASKED_SQL)
        said = materialise(firsts.groupBy("bucket").applyInArrow(second, kind), f"{tag}-sums")
        sums = said.select(F.col("chunk").alias("salt"), F.floor(F.col("bucket") / parts).alias("bucket"), F.col("bucket").alias("part"), F.col("counts").alias("sums"))
        out = materialise(dealt.groupBy("bucket", "salt").cogroup(sums.groupBy("bucket", "salt")).applyInArrow(last, kind), tag)
    totals = said.filter("facts is not null").select(F.posexplode("facts")).groupBy("pos").agg(F.sum("col")).collect()  # a few numbers
    totals = dict(map(tuple, totals))
    return out.select("chunk", "bucket", "counts"), [totals.get(i, 0) for i in range(max(totals, default=-1) + 1)]
