"""Trie of the prefixes of conversations, by smallest-member ownership.

A node is named by its depth and a polynomial hash of its turns (modulo 2 ** 127 - 1, over 127 bits of each turn's SHA-256). A node
belongs to its smallest member. If a conversation owns a node, it owns all that follow on its path: it owns a suffix of the path. Windows
mark the owned nodes, first over parts of a prefix, then over the few winners of its parts, so that no task meets a whole hot prefix.
From where a conversation's suffix starts, what hangs below any node follows without a walk through the tree. Of the occurrences
(conversation, node),

- an unowned one weighs the bytes from its depth to where its conversation's suffix starts: summed, these are the bytes of all
  occurrences below the node less those of the distinct nodes below it, since the distinct ones are the owned ones;
- one whose conversation owns a childless node counts that leaf, at all of its ancestors;
- one whose conversation owns the next node of its path counts a child.

So one group-by over prefixes sums all columns. Hashes, places and byte counts along a conversation are running sums over runs: turns are
range-partitioned by (conversation, turn), each task scans its runs, and what came before a run is added from the sums of the runs before.
So a conversation of any length, too, is spread over tasks.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table

#: Of GROUP consecutive ids, the conversations start with up to HEAD - 1 turns of the first one; how many, a checksum of the id says.
GROUP, HEAD = 5, 9
_P = (1 << 127) - 1
_B = int.from_bytes(hashlib.sha256(b"prefix trie").digest()[:15], "big")
_LIST = 1 << 14  # ids in a piece of a list that is digested


def _key(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _number(raw: bytes | None) -> int:
    return int.from_bytes(raw or b"", "big")


def _batch(spec: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(x.split() for x in spec.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


_RUNS = "part bigint, c bigint, i bigint, p binary, q binary, sum bigint, n bigint"


def _runs(turns: DataFrame) -> DataFrame:
    """turns (c, turn, x, n) by range: part, c, i (place in the run of c in that partition), p and q (hash of the run with this turn, and
    without), sum (its bytes up to here), n."""

    def run(batches):
        part, now, i, p, total = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            out = []
            for c, x, n in zip(*(batch.column(k).to_pylist() for k in ("c", "x", "n")), strict=True):
                if c != now:
                    now, i, p, total = c, 0, 0, 0
                q, i, total = p, i + 1, total + n
                p = (q * _B + (_number(x) >> 1) + 1) % _P
                out.append((part, c, i, _key(p), _key(q), total, n))
            yield _batch(_RUNS, list(zip(*out, strict=True)) or [[]] * 7)

    order = [F.col("c"), F.asc_nulls_first("turn"), F.col("x")]
    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _RUNS)


_BEFORE = "c bigint, part bigint, i0 bigint, p0 binary, sum0 bigint"


def _before(runs: DataFrame) -> DataFrame:
    """What comes before each run of the conversations that lie in several partitions. There are fewer of these than partitions, and two
    runs a partition at most."""
    some = runs.groupBy("c").agg(F.min("part").alias("a"), F.max("part").alias("z")).filter("a < z").select("c")
    ends = runs.join(F.broadcast(some), "c", "left_semi").groupBy("c", "part").agg(F.max("i").alias("i"), F.max_by("p", "i").alias("p"), F.max("sum").alias("sum"))

    def run(key, rows):
        out, i, p, total = [], 0, 0, 0
        for part, k, raw, s in sorted(zip(*(rows.column(x).to_pylist() for x in ("part", "i", "p", "sum")), strict=True)):
            out.append((key[0].as_py(), part, i, _key(p), total))
            i, p, total = i + k, (p * pow(_B, k, _P) + _number(raw)) % _P, total + s
        return pa.Table.from_batches([_batch(_BEFORE, list(zip(*out, strict=True)))])

    return ends.groupBy("c").applyInArrow(run, _BEFORE)


def _whole(runs: DataFrame) -> DataFrame:
    """runs, with i, p, q and sum counted from the first turn of the conversation."""
    spec = "c bigint, i bigint, p binary, q binary, sum bigint, n bigint"

    def run(batches):
        for b in batches:
            said = [b.column(k).to_pylist() for k in ("i", "p", "q", "sum", "i0", "p0", "sum0")]
            made = []
            for i, p, q, total, i0, p0, sum0 in zip(*said, strict=True):
                if i0:
                    at = _number(p0) * pow(_B, i - 1, _P)
                    i, p, q, total = i + i0, _key((at * _B + _number(p)) % _P), _key((at + _number(q)) % _P), total + sum0
                made.append((i, p, q, total))
            yield _batch(spec, [b.column("c"), *(list(zip(*made, strict=True)) or [[]] * 4), b.column("n")])

    return runs.join(F.broadcast(_before(runs)), ["c", "part"], "left").select("c", "i", "p", "q", "sum", "n", "i0", "p0", "sum0").mapInArrow(run, spec)


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, known). paths: a row for each node on each conversation's path: c, d, k and q (hashes of the node and its parent), before
    (bytes of the turns above this one), n (bytes of this one), len. known: a row for each conversation: c, len, bytes. Both are written."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.select(F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("x"), F.octet_length(text).cast("long").alias("n")).filter("c IS NOT NULL")
    turns = materialise(_whole(materialise(_runs(turns), "trie-runs")), "trie-turns")
    sizes = turns.groupBy("c").agg(F.count("*").alias("own"), F.sum("n").alias("own_bytes"))
    heads = turns.filter(F.col("i") < HEAD).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "p", "q", "sum", "n"))).alias("head"))  # HEAD - 1 turns at most
    known = sizes.join(heads, "c").withColumn("h", F.crc32(F.col("c").cast("string")) % HEAD).withColumn("base", F.col("c") - F.col("c") % GROUP)
    known = known.join(heads.select(F.col("c").alias("base"), F.col("head").alias("first")), "base", "left")
    known = known.withColumn("first", F.expr("slice(coalesce(first, slice(head, 1, 0)), 1, int(h))")).withColumn("n0", F.size("first").cast("long"))
    mine = F.expr("int(least(h, own))")
    end = lambda of, at, what: F.get(of, at - 1)[what]
    known = known.select(
        "c", "h", "n0", "first",
        end("first", F.col("n0").cast("int"), "p").alias("given"), F.coalesce(end("first", F.col("n0").cast("int"), "sum"), F.lit(0)).alias("given_sum"),
        end("head", mine, "p").alias("lost"), F.coalesce(end("head", mine, "sum"), F.lit(0)).alias("lost_sum"),
        (F.col("n0") + F.col("own") - mine).alias("len"), "own_bytes",
    ).withColumn("bytes", F.expr("given_sum + own_bytes - lost_sum"))
    known = materialise(known, "trie-known")

    spec = "c bigint, d bigint, k binary, q binary, before bigint, n bigint, len bigint"

    def run(batches):
        powers: dict[int, int] = {}
        for b in batches:
            keys, parents = [], []
            for i, p, q, h, given, lost in zip(*(b.column(x).to_pylist() for x in ("i", "p", "q", "h", "given", "lost")), strict=True):
                if len(powers) > 1 << 16:
                    powers.clear()
                if (power := powers.get(i - h)) is None:
                    power = powers[i - h] = pow(_B, i - h - 1, _P)
                at = power * (_number(given) - _number(lost))
                keys.append(_key((at * _B + _number(p)) % _P))
                parents.append(_key((at + _number(q)) % _P))
            yield _batch(spec, [b.column("c"), b.column("d"), keys, parents, b.column("before"), b.column("n"), b.column("len")])

    own = turns.join(known.select("c", "h", "n0", "given", "lost", "given_sum", "lost_sum", "len"), "c").filter("i > h")
    own = own.selectExpr("c", "i", "p", "q", "h", "given", "lost", "n0 + i - h AS d", "given_sum + sum - n - lost_sum AS before", "n", "len").mapInArrow(run, spec)
    root = F.lit(_key(0))
    copied = known.select("c", "len", F.explode("first").alias("t")).selectExpr("c", "t.i AS d", "t.p AS k", "t.q AS q", "t.sum - t.n AS before", "t.n AS n", "len")
    roots = known.select("c", F.lit(0).cast("long").alias("d"), root.alias("k"), root.alias("q"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("n"), "len")
    half = lambda of, at: F.conv(F.hex(F.substring(of, at, 8)), 16, -10).cast("long")
    paths = own.unionByName(copied).unionByName(roots)
    paths = paths.select("c", "d", *[half(x, at).alias(f"{x}{j}") for x in "kq" for j, at in ((1, 1), (2, 9))], "before", "n", "len")
    return materialise(paths, "trie-paths"), known.select("c", "len", "bytes")


_NODE = ["d", "k1", "k2"]


def _owners(paths: DataFrame, known: DataFrame) -> DataFrame:
    """c, len, s (depth from which c owns its path; beyond len if it owns nothing), above (bytes before that depth), leaf (1 if c owns a
    childless node), up (the owner of the node at s - 1)."""
    parts = paths.withColumn("part", F.pmod(F.xxhash64("c"), F.lit(shuffle_partitions(paths.sparkSession))))
    some, whole = Window.partitionBy(*_NODE, "part"), Window.partitionBy(*_NODE)
    marked = parts.withColumn("least", F.min("c").over(some)).withColumn("deepest", F.max("len").over(some)).filter("c = least")
    marked = marked.withColumn("least", F.min("c").over(whole)).withColumn("deepest", F.max("deepest").over(whole)).filter("c = least")
    owned = materialise(marked.select("c", *_NODE, "q1", "q2", "before", (F.col("deepest") == F.col("d")).cast("long").alias("leaf")), "trie-owned")
    tops = owned.groupBy("c").agg(F.min("d").alias("s"), F.min("before").alias("above"), F.max("leaf").alias("leaf"), F.min_by("q1", "d").alias("k1"), F.min_by("q2", "d").alias("k2"))
    tops = tops.withColumn("d", F.col("s") - 1).join(owned.select(F.col("c").alias("up"), *_NODE), _NODE, "left").select("c", "s", "above", "leaf", "up")
    return known.join(tops, "c", "left").selectExpr("c", "coalesce(s, len + 1) AS s", "coalesce(above, bytes) AS above", "coalesce(leaf, 0L) AS leaf", "up")


def _ends(paths: DataFrame) -> DataFrame:
    """d, k1, k2, ends_sha256 of the nodes where conversations end. The sorted ids are joined by pieces, in ranges of (node, id); the
    digest then runs over the pieces of a node, one at a time."""
    first_spec = "d bigint, k1 bigint, k2 bigint, least bigint, said string"

    def pieces(batches):
        now, ids = None, []
        for b in batches:
            out = []
            for *node, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if node != now or len(ids) >= _LIST:
                    if ids:
                        out.append((*now, ids[0], ",".join(map(str, ids))))
                    now, ids = node, []
                ids.append(c)
            if out:
                yield _batch(first_spec, list(zip(*out, strict=True)))
        if ids:
            yield _batch(first_spec, list(zip((*now, ids[0], ",".join(map(str, ids))), strict=True)))

    def digests(batches):
        now, sha = None, None
        for b in batches:
            out = []
            for *node, said in zip(*(b.column(x).to_pylist() for x in (*_NODE, "said")), strict=True):
                if node != now:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(said.encode())
            if out:
                yield _batch(spec, list(zip(*out, strict=True)))
        if sha:
            yield _batch(spec, list(zip((*now, sha.hexdigest()), strict=True)))

    spec = "d bigint, k1 bigint, k2 bigint, ends_sha256 string"
    last = paths.filter("d = len").select(*_NODE, "c")
    order = [*_NODE, "c"]
    said = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, first_spec)
    return said.repartition(*_NODE).sortWithinPartitions(*_NODE, "least").mapInArrow(digests, spec)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text), a row each: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first; of equal ones by a digest of role and text, so repeated turns all stay. Null role or text is
    empty. Rows without conv_id belong to no conversation and are left out; negative ids are grouped by the remainder that keeps their
    sign. Other columns play no part, whatever their names. An empty table has no node, not even a root.
    """
    paths, known = rebuilt(conversations)
    owners = materialise(_owners(paths, known), "trie-owners")
    seen = paths.join(owners, "c").select(
        *_NODE, "len", "leaf",
        F.expr("CASE WHEN d >= s THEN c END").alias("owner"),
        F.expr("CASE WHEN d > s THEN c WHEN d = s THEN up END").alias("parent"),
        F.expr("CASE WHEN s <= d + 1 AND d < len THEN 1L ELSE 0L END").alias("child"),
        F.expr("greatest(above - before, 0L)").alias("unowned"),
    )
    nodes = seen.groupBy(*_NODE).agg(
        F.max("owner").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum("unowned").alias("saved_tokens"),
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = nodes.join(_ends(paths), _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: The checksum is spelled out bit by bit; a node is known by the digests of its turns, joined.
ORACLE_SQL = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(r)::VARCHAR || ':' || r || x)) AS i,
                  strlen(x) AS n, sha256(strlen(r)::VARCHAR || ':' || r || x) AS s
           FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
e AS (SELECT DISTINCT c, c - c % 5 AS b, [ord(y)::BIGINT FOR y IN string_split(c::VARCHAR, '')] AS bytes FROM t),
h AS (SELECT c, b, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, y: list_reduce(list_prepend(xor(a, y), range(8)), lambda v, _: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS h FROM e),
g AS (SELECT h.c, t.i AS d, t.n, t.s FROM h JOIN t ON t.c = h.b AND t.i <= h.h),
k AS (SELECT h.c, h.h, coalesce(m, 0) AS m FROM h LEFT JOIN (SELECT c, max(d) AS m FROM g GROUP BY c) USING (c)),
o AS (SELECT * FROM g UNION ALL SELECT t.c, k.m + t.i - k.h, t.n, t.s FROM t JOIN k USING (c) WHERE t.i > k.h),
q AS (SELECT c, d, n, string_agg(s, '') OVER (PARTITION BY c ORDER BY d) AS key FROM o UNION ALL SELECT c, 0, 0, '' FROM k),
z AS (SELECT *, max(d) OVER (PARTITION BY c) AS len FROM q),
v AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256 FROM z GROUP BY d, key),
f AS (SELECT v.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM v w WHERE w.d = v.d + 1 AND starts_with(w.key, v.key)) AS n_children
      FROM v LEFT JOIN v p ON p.d = v.d - 1 AND starts_with(v.key, p.key))
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0)::BIGINT AS n_leaves,
       sum((b.n_convs - 1) * b.n)::BIGINT AS saved_tokens, a.ends_sha256
FROM f a JOIN f b ON b.d >= a.d AND starts_with(b.key, a.key) GROUP BY ALL
"""
