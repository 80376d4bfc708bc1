"""Suffix-array removal of repeated passages, by deep-shallow sorting.

A byte goes if it is covered by a WIDTH-byte string that also starts in a document
with a smaller id. Documents are packed into compressed chunks of CHUNK bytes, and
four steps follow, each over all chunks or all buckets of hashes:

1. A chunk cuts its texts into stretches: neighbouring places whose WIDTH-byte
   strings have the same least hash of GRAM-byte grams. It sends each hash once, with
   the number of its stretches and documents, packed by bucket of hashes.
2. A bucket answers with a state of each hash: it is in two documents or more, or so
   many stretches have it, too, that they are to be split.
3. A chunk sends each different stretch of a shared hash once, with its least document,
   to the task of the hash. Stretches of a hash to be split go as single strings, to the
   task of the string. A task orders all its strings: multikey quicksort, which parts
   them in three by a pivot word of 8 bytes to a shallow depth, then a blind trie for
   each group that still shares its prefix. Equal strings are then neighbours, the least
   document of each run of them decides, and chunks are told where it is smaller than
   their own.
4. A chunk marks and removes.

A hash or stretch that a third of all documents have is one entry of a chunk. Hashes,
and the stretches of a task, are added up in two levels beyond chunks.MOST of them, so
what meets in a task grows with the square root of the number of chunks, not with the
number of copies. A document is never cut: one beyond CHUNK is a chunk by itself, whose
hashes are made piece by piece.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .chunks import batch_of, chunks, deflate, inflate, pack, ranges, unpack
from .common import materialise, shuffle_partitions, table

WIDTH, GRAM = 50, 20
#: Bits of a hash.
BITS = 48
#: Bytes that the shallow sort compares, a multiple of 8; parts of at most SMALL strings it orders by one plain sort.
SHALLOW, SMALL = 32, 2048
#: Bytes of text that a bucket of hashes stands for, and of stretches that a task sorts.
BUCKET, TASK = 16 << 20, 4 << 20
#: Stretches of one hash beyond which they are dealt as single strings.
HOT = 20_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PIECE = 1 << 18
_NEVER = np.iinfo(np.int64).max


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, big-endian: numbers in the order of the bytes."""
    v, n = np.zeros(max(0, len(data) - 7), np.uint64), max(0, len(data) - 7)
    for i in range(8):
        v <<= np.uint64(8)
        v |= data[i : i + n]
    return v


def _least_hashes(data: np.ndarray) -> np.ndarray:
    """For each WIDTH-byte string of data the least hash, of BITS bits, of its grams."""
    if len(data) < WIDTH:
        return np.zeros(0, np.uint64)
    v = _words(data)
    n = len(data) - GRAM + 1
    h = (v[:n] * _A) ^ ((v[8 : 8 + n] ^ (v[:n] >> np.uint64(29))) * _B) ^ (v[12 : 12 + n] * _A)
    h ^= h >> np.uint64(31)
    h *= _B
    h ^= h >> np.uint64(30)
    h >>= np.uint64(64 - BITS)
    span, have = WIDTH - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def stretches(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least hash, start, number of places, document) of the stretches of the documents that lie one after another in data. Every
    WIDTH-byte string of a document is in one of them. Made by pieces: memory beyond the result is bounded by a piece."""
    ends = np.cumsum(lengths)
    out = []
    for p in range(0, len(data), _PIECE):
        low = _least_hashes(data[p : p + _PIECE + WIDTH - 1])
        if not len(low):
            break
        at = np.arange(p, p + len(low), dtype=np.int64)
        a, b = np.searchsorted(ends, (p, p + len(low) - 1), "right").tolist()
        own = np.repeat(np.arange(a, b + 1), np.diff(np.clip(ends[a : b + 1], p, p + len(low)), prepend=p))
        inside = at + WIDTH <= ends[own]  # between two documents are WIDTH - 1 places whose strings belong to neither
        fresh = np.ones(len(low) + 1, bool)
        fresh[1:-1] = (low[1:] != low[:-1]) | ~inside[:-1] | ~inside[1:]
        heads = np.flatnonzero(fresh)
        n, heads = np.diff(heads), heads[:-1]
        good = inside[heads]
        heads = heads[good]
        # The least of many hashes is a small number: spread evenly again, or the first bucket would hold half of all.
        spread = (low[heads] * _A) & np.uint64((1 << BITS) - 1)
        out.append((spread.astype(np.int64), at[heads], n[good], own[heads]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def blind_trie(strings: list[bytes]) -> list[int]:
    """The order of strings. An inner node keeps only the place and the bytes at which its strings part: a string is led blindly
    to a leaf, compared with it once, and put in where they first differ."""
    root: list = [None, [0]]  # a leaf: [None, indexes of equal strings]; a node: [place, {byte: child}]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        if s == other:
            node[1].append(i)
            continue
        d = next(k for k in range(len(s)) if s[k] != other[k])
        node = root
        while node[0] is not None and node[0] < d:
            node = node[1][s[node[0]]]
        if node[0] == d:
            node[1][s[d]] = [None, [i]]
        else:
            old = [node[0], node[1]]
            node[0], node[1] = d, {other[d]: old, s[d]: [None, [i]]}
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def _by_groups(order: np.ndarray, words: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level of multikey quicksort for all groups at once: order holds groups of strings, which begin at heads, and words the
    word of each. Every group is parted in three by a pivot, less, equal and greater, until its parts are small; those are put in
    order by a plain sort. Returns the new order, and its words."""
    sizes = np.diff(np.append(heads, len(order)))
    big = sizes > SMALL
    done = []  # (places, which are all of a part)
    at_small = np.repeat(heads[~big], sizes[~big]) + ranges(sizes[~big])
    done.append((at_small, np.repeat(heads[~big], sizes[~big])))
    todo = [(int(a), int(a + n)) for a, n in zip(heads[big], sizes[big], strict=True)]
    while todo:
        a, b = todo.pop()
        w = words[a:b]
        some = np.sort(w[:: (b - a) // 101])
        pivot = some[len(some) // 2]
        less, more = w < pivot, w > pivot
        by = np.concatenate([np.flatnonzero(less), np.flatnonzero(~(less | more)), np.flatnonzero(more)])
        order[a:b], words[a:b] = order[a:b][by], w[by]
        n_less, n_more = int(less.sum()), int(more.sum())
        for x, y in ((a, a + n_less), (b - n_more, b)):
            if y - x > SMALL:
                todo.append((x, y))
            elif y - x > 1:
                done.append((np.arange(x, y), np.full(y - x, x)))
    at, part = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.lexsort([words[at], part])
    first = np.argsort(part, kind="stable")
    order[at[first]], words[at[first]] = order[at[by]], words[at[by]]
    return order, words


def deep_shallow(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the WIDTH-byte strings of data at starts, and for each in that order whether it differs from the one before."""
    v = _words(data)
    order, fresh = np.arange(len(starts)), np.zeros(len(starts), bool)
    fresh[:1] = True
    for depth in range(0, SHALLOW, 8):  # only strings that are equal so far are compared further
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.append(heads, len(order)))
        tied = np.repeat(heads[sizes > 1], sizes[sizes > 1]) + ranges(sizes[sizes > 1])
        if not len(tied):
            break
        begins = np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1]
        part, w = _by_groups(order[tied], v[starts[order[tied]] + depth], begins)
        order[tied] = part
        fresh[tied[1:]] |= w[1:] != w[:-1]
    del v
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, len(order)))
    raw = data.tobytes()
    for a, n in zip(heads[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        group = order[a : a + n]
        strings = [raw[s + SHALLOW : s + WIDTH] for s in starts[group].tolist()]
        by = blind_trie(strings)
        order[a : a + n] = group[by]
        fresh[a + 1 : a + n] = [strings[x] != strings[y] for x, y in zip(by, by[1:], strict=False)]
    return order, fresh


class _Chunk:
    """An unpacked chunk, and its stretches by hash, then place."""

    def __init__(self, docs: bytes, texts: bytes, n_buckets: int):
        self.has, self.ids, self.lengths = unpack(docs, 3)
        self.raw = inflate(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        known = int(self.has.sum())  # documents without an id come last and take no part
        low, start, n, owner = stretches(self.data[: self.lengths[:known].sum()], self.lengths[:known])
        order = np.argsort(low, kind="stable")
        self.low, self.start, self.n, self.owner = low[order], start[order], n[order], owner[order]
        self.fresh = np.ones(len(low), bool)
        self.fresh[1:] = self.low[1:] != self.low[:-1]
        self.lows = self.low[self.fresh]
        # A hash's bucket is its range of values, so that buckets are slices of the sorted hashes.
        self.cuts = C.cuts(self.lows, n_buckets, BITS)

    def requests(self):
        """(bucket, hashes, stretches and documents of each)."""
        heads = np.flatnonzero(self.fresh)
        other = self.fresh.copy()
        doc = self.ids[self.owner]
        other[1:] |= doc[1:] != doc[:-1]
        docs = np.add.reduceat(other.astype(np.int64), heads) if len(heads) else heads
        count = np.diff(np.append(heads, len(self.low)))
        for b, (i, j) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            if j > i:
                yield b, pack(np.diff(self.lows[i:j], prepend=0), count[i:j], docs[i:j])

    def parts(self, answers):
        """What the chunk sends, and where it has it. answers: (bucket, packed states of its hashes). Sets

        - text, key, n, least: of each part (a different stretch, or a string of those that are to be split) its bytes, what decides
          its task, number of places and least document;
        - of_part, of_piece, offset: the places of parts in pieces, the different stretches;
        - piece, start, doc: the stretches that are shared, and the least documents of their pieces."""
        state = np.zeros(len(self.lows), np.int8)
        for b, blob in answers:
            state[self.cuts[b] : self.cuts[b + 1]] = np.frombuffer(inflate(blob), np.int8)
        state = state[np.cumsum(self.fresh) - 1] if len(self.low) else state
        at = np.flatnonzero(state)
        self.start, self.doc, n, low, split = self.start[at], self.ids[self.owner[at]], self.n[at], self.low[at], state[at] == 2
        seen: dict[bytes, int] = {}
        ends = (self.start + n + WIDTH - 1).tolist()
        self.piece = np.array([seen.setdefault(self.raw[a:e], len(seen)) for a, e in zip(self.start.tolist(), ends, strict=True)], np.int64)
        first = np.full(len(seen), len(at), np.int64)
        np.minimum.at(first, self.piece, np.arange(len(at)))
        self.least_of = np.full(len(seen), _NEVER)
        np.minimum.at(self.least_of, self.piece, self.doc)
        parts: dict[bytes, int] = {}
        of_part, of_piece, offset, key = [], [], [], []
        for i, (text, k, h, s) in enumerate(zip(seen, n[first].tolist(), low[first].tolist(), split[first].tolist(), strict=True)):
            for o in range(k) if s else (0,):
                t = text[o : o + WIDTH] if s else text
                number = parts.setdefault(t, len(parts))
                if number == len(key):
                    key.append(int.from_bytes(hashlib.blake2b(t, digest_size=6).digest(), "little") if s else h)
                of_part.append(number), of_piece.append(i), offset.append(o)
        self.of_part, self.of_piece, self.offset, self.key = (np.array(x, np.int64) for x in (of_part, of_piece, offset, key))
        self.text = list(parts)
        self.n = np.array([len(t) - WIDTH + 1 for t in self.text], np.int64)
        self.least = np.full(len(parts), _NEVER)
        np.minimum.at(self.least, self.of_part, self.least_of[self.of_piece])
        return self

    def by_task(self, n_tasks: int):
        """(task, the numbers of the parts that go there, in order)."""
        task = ((self.key.astype(np.uint64) * _A) >> np.uint64(20)).astype(np.int64) % n_tasks
        order = np.lexsort([self.key, task])
        at = np.flatnonzero(np.diff(task[order], prepend=-1, append=n_tasks))
        return [(int(task[order[i]]), order[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def removed(self, runs) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of what is removed: maximal, apart, in order. runs: (task, packed runs of its parts)."""
        places = dict(runs[0])
        got = [(places[t], unpack(s, 4)) for t, s in runs[1]]
        # A part's least document of this chunk comes before all others of the chunk that have it.
        own = (np.zeros(len(self.n), np.int64), self.n + WIDTH - 1, self.least)
        part = np.concatenate([np.arange(len(self.n)), *(at[np.cumsum(r[0])] for at, r in got)])
        a, b, by = (np.concatenate([own[i - 1], *(r[i] for _, r in got)]) for i in (1, 2, 3))
        # The runs of each part, then of each piece, then of each stretch.
        order = np.argsort(part, kind="stable")
        a, b, by, n = a[order], b[order], by[order], np.bincount(part, minlength=len(self.text))
        at, k = _spread(n, self.of_part)
        a, b, by = a[at] + self.offset[k], b[at] + self.offset[k], by[at]
        piece = self.of_piece[k]  # in order
        at, k = _spread(np.bincount(piece, minlength=len(self.least_of)), self.piece)
        hit = self.doc[k] > by[at]
        at, k = at[hit], k[hit]
        begin, end = self.start[k] + a[at], self.start[k] + b[at]
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
        starts = np.cumsum(self.lengths)[:-1]
        fresh = np.ones(len(begin), bool)
        # Neighbours across the border of two documents stay apart.
        fresh[1:] = (begin[1:] > end[:-1]) | ((begin[1:] == end[:-1]) & np.isin(begin[1:], starts))
        heads = np.flatnonzero(fresh)
        return begin[heads], end[np.append(heads[1:], len(begin)) - 1] if len(heads) else end


def _spread(n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group, n of each: the rows of group of[0], of[1] and so on, and for each which of these it belongs to."""
    first = np.cumsum(n) - n
    return np.repeat(first[of], n[of]) + ranges(n[of]), np.repeat(np.arange(len(of)), n[of])


def _state(sums) -> bytes:
    """Of each hash: 0 in one document, 1 shared, 2 shared and to be split."""
    count, docs = sums
    return deflate(((docs > 1).astype(np.int8) + ((docs > 1) & (count > HOT))).astype(np.int8).tobytes())


def _united(rows):
    """The different parts of a task's rows with their least document, and which of them each row sent."""
    sent = [unpack(x, 2) for x in rows.column("heads").to_pylist()]
    seen: dict[bytes, int] = {}
    which = []
    for (n, _), blob in zip(sent, rows.column("parts").to_pylist(), strict=True):
        raw, ends = inflate(blob), np.cumsum(n + WIDTH - 1).tolist()
        which.append(np.array([seen.setdefault(raw[a:e], len(seen)) for a, e in zip([0, *ends], ends, strict=False)], np.int64))
    docs = np.full(len(seen), _NEVER)
    np.minimum.at(docs, np.concatenate(which), np.concatenate([s[1] for s in sent]))
    return list(seen), docs, which, [s[1] for s in sent]


def _least_of_each(texts: list[bytes], piece: int = 1 << 20) -> np.ndarray:
    """The least hash of each text, of WIDTH bytes or more; texts are hashed together, about piece bytes at a time."""
    out, begin, sizes = [], 0, np.array([len(t) for t in texts])
    while begin < len(texts):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), piece, "right")))
        some = sizes[begin:end]
        least, starts = _least_hashes(np.frombuffer(b"".join(texts[begin:end]), np.uint8)), np.cumsum(some) - some
        edges = np.stack([starts, starts + some - WIDTH + 1], axis=1).ravel()  # places past a text's last string belong to none
        out.append(np.minimum.reduceat(np.append(least, least[-1]), edges)[::2])
        begin = end
    return np.concatenate([np.zeros(0, np.uint64), *out])


def _runs(texts: list[bytes], docs: np.ndarray):
    """(part, begin, end, least document) of the runs of places of each part whose strings have the same least document of all."""
    counts = np.array([len(t) - WIDTH + 1 for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner, offset = np.repeat(np.arange(len(texts)), counts), ranges(counts)
    order, fresh = deep_shallow(data, (np.cumsum(counts + WIDTH - 1) - counts - WIDTH + 1)[owner] + offset)
    lows, heads = np.empty(len(owner), np.int64), np.flatnonzero(fresh)
    lows[order] = np.repeat(np.minimum.reduceat(docs[owner[order]], heads), np.diff(np.append(heads, len(order))))
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (lows[1:] != lows[:-1])]))
    return owner[cut], offset[cut], offset[np.append(cut[1:], len(owner)) - 1] + WIDTH, lows[cut]


def _told(rows, which, own, runs, task: str):
    """For each row the runs of its parts, in the order it sent them, whose least document is smaller than the row's own."""
    part, a, b, by = runs
    n, out = np.bincount(part, minlength=int(part[-1]) + 1), []
    for parts, mine in zip(which, own, strict=True):
        at, number = _spread(n, parts)
        less = by[at] < mine[number]
        at, number = at[less], number[less]
        out.append(pack(np.diff(number, prepend=0), a[at], b[at], by[at]))
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column(task), "counts": pa.array(out, pa.binary())})


_SENT = {"chunk": pa.int64(), "task": pa.int64(), "heads": pa.binary(), "parts": pa.binary()}
_SENT_SQL = "chunk bigint, task bigint, heads binary, parts binary"


def _sorted(sent: DataFrame, n_tasks: int, parts: int) -> DataFrame:
    """(chunk, bucket: task, counts: packed runs) for the parts (chunk, task, heads, parts) that chunks sent. With parts > 1, groups
    of chunks unite their own first, so that a stretch that every chunk has is one entry of a group."""

    def at_once(key, rows):
        texts, docs, which, own = _united(rows)
        return _told(rows, which, own, _runs(texts, docs), "task")

    if parts == 1:
        return sent.groupBy("task").applyInArrow(at_once, C.ASKED_SQL)
    dealt = materialise(sent.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(parts))), "suffix-sent")

    def by_second(texts: list[bytes]) -> dict[int, list[int]]:
        """The places of texts by their second level: by a gram that overlapping strings share as their stretch does."""
        by = {}
        for i, h in enumerate(_least_of_each(texts).tolist()):
            by.setdefault(h % parts, []).append(i)
        return by

    def first(key, rows):
        texts, docs, _, _ = _united(rows.sort_by("chunk"))  # in this order again in last()
        task, salt, by = key[0].as_py(), key[1].as_py(), by_second(texts)
        made = [(salt, task * parts + p, pack(np.array([len(texts[i]) - WIDTH + 1 for i in at]), docs[at]), deflate(b"".join([texts[i] for i in at]))) for p, at in by.items()]
        return pa.Table.from_batches([batch_of(_SENT, made)])

    def second(key, rows):
        texts, docs, which, _ = _united(rows)
        return _told(rows, which, [np.full(len(w), _NEVER) for w in which], _runs(texts, docs), "task")

    def last(key, rows, said):
        if not rows.num_rows:
            return pa.Table.from_batches([batch_of(C.ASKED, [])])
        rows = rows.sort_by("chunk")
        texts, _, which, own = _united(rows)
        by = by_second(texts)
        runs = []
        for p, blob in zip(said.column("part").to_pylist(), said.column("counts").to_pylist(), strict=True):
            r = unpack(blob, 4)
            runs.append((np.array(by[p])[np.cumsum(r[0])], *r[1:]))
        runs = [np.concatenate(x) for x in zip(*runs, strict=True)]
        order = np.argsort(runs[0], kind="stable")
        return _told(rows, which, own, [x[order] for x in runs], "task")

    firsts = dealt.groupBy("task", "salt").applyInArrow(first, _SENT_SQL)
    said = firsts.groupBy("task").applyInArrow(second, C.ASKED_SQL)
    part = F.col("bucket")
    said = said.select(F.col("chunk").alias("salt"), F.floor(part / parts).alias("task"), (part % parts).alias("part"), "counts")
    return dealt.groupBy("task", "salt").cogroup(said.groupBy("task", "salt")).applyInArrow(last, C.ASKED_SQL)


def dedup(docs: DataFrame, texts: bool = True, most: int = C.MOST, chunk: int = C.CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept (the bytes that stay) for each row of docs (doc_id, text).

    Null text is empty. Matches never cross documents; a document doesn't repeat itself. Rows with a null id keep all and repeat for
    nobody; rows of one id are judged alike against smaller ids. Other columns of docs are not carried, whatever their names. An empty
    table gives an empty result. most: the buckets, or tasks, that a chunk of so many bytes sends to at once.
    """
    spark = docs.sparkSession
    packed = chunks(docs, "suffix-chunks", chunk)
    total = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).head()[0]
    n_buckets, bucket_parts = C.levels(max(shuffle_partitions(spark), -(-total // BUCKET)), most)

    def ask(batches):
        for batch in batches:
            for c, docs_, texts_ in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                yield batch_of(C.ASKED, [(c, *r) for r in _Chunk(docs_, texts_, n_buckets).requests()])

    asked = packed.select("chunk", "docs", "texts").mapInArrow(ask, C.ASKED_SQL)
    n_shared = lambda keys, sums: [int(sums[0][sums[1] > 1].sum())]
    answers, shared = C.tally(asked, 2, n_buckets, bucket_parts, BITS, n_shared, _state, "suffix-answers")
    n_tasks, task_parts = C.levels(max(shuffle_partitions(spark), -(-sum(shared) * 2 * WIDTH // TASK)), most)

    def send(key, mine, states):
        rows = []
        for c, docs_, texts_ in zip(*(mine.column(x).to_pylist() for x in ("chunk", "docs", "texts")), strict=True):
            made = _Chunk(docs_, texts_, n_buckets).parts(zip(states.column("bucket").to_pylist(), states.column("counts").to_pylist(), strict=True))
            rows += [(c, t, pack(made.n[at], made.least[at]), deflate(b"".join([made.text[i] for i in at.tolist()]))) for t, at in made.by_task(n_tasks)]
        return pa.Table.from_batches([batch_of(_SENT, rows)])

    sent = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(send, _SENT_SQL)
    found = _sorted(sent, n_tasks, task_parts)
    told = answers.withColumn("first", F.lit(True)).unionByName(found.withColumn("first", F.lit(False)))
    result = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    result |= {"kept": pa.binary()} if texts else {}

    def mark(key, mine, told_):
        rows = []
        said = list(zip(*(told_.column(x).to_pylist() for x in ("bucket", "counts", "first")), strict=True))
        for docs_, texts_ in zip(mine.column("docs").to_pylist(), mine.column("texts").to_pylist(), strict=True):
            made = _Chunk(docs_, texts_, n_buckets).parts((b, s) for b, s, first in said if first)
            begins, ends = made.removed((made.by_task(n_tasks), [(b, s) for b, s, first in said if not first]))
            end, borders = 0, np.searchsorted(begins, np.append(0, np.cumsum(made.lengths))).tolist()
            for has, d, k, i, j in zip(made.has.tolist(), made.ids.tolist(), made.lengths.tolist(), borders, borders[1:], strict=False):
                begin, end = end, end + k
                a, b = [begin, *ends[i:j].tolist()], [*begins[i:j].tolist(), end]
                kept = b"".join([made.raw[x:y] for x, y in zip(a, b, strict=True)])
                rows.append((d if has else None, k, k - len(kept), j - i, hashlib.sha256(kept).hexdigest(), kept))
        return pa.Table.from_batches([batch_of(result, rows)])

    kinds = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if texts else "")
    return packed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(mark, kinds)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
