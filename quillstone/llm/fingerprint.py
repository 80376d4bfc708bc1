"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a line that isn't empty. Its hash is a wide vector, and a document's
fingerprint is the sum of its paragraphs' vectors, modulo powers of two: documents with
the same paragraphs in any order have equal fingerprints, and a paragraph is inserted or
deleted by adding or subtracting its fingerprint (`combine`), without the other text.

The vector has three parts:

- LANES numbers modulo 2 ** 32, from hashes of the whole paragraph. They decide equality.
- the number of the paragraph's pieces. A paragraph is cut where its content says: a
  piece ends with the first separator after LEAST code points, or at MOST, so that an
  insertion changes the pieces around it only.
- 2 * HALF * HASHES counters of 31 bits, two to a long: counter k counts the pieces whose
  hash has bit k set. Centred by the number of pieces, the counters are a random
  projection of the multiset of pieces, so their cosine estimates how much two texts
  share, with an error of about 1 / sqrt(124).

The likeness to an edited text uses the sums, too: what an edit leaves in place is hashed
once, and the fingerprint of the edited text is that sum and the sum of the new end.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, whole

LANES = 8
LEAST, MOST = 8, 48
HASHES, HALF = 2, 31
#: Bytes of the input that a range of documents stands for, and the most ranges that the driver makes.
RANGE, RANGES = 64 << 20, 1 << 14
_ONES = 1 | 1 << HALF
_PIECE = r"([^\n]{%d,%d}?(?:[^\p{L}\p{N}\n]|(?=\n)|$)|[^\n]{1,%d})" % (LEAST, MOST, MOST)
_PACKED = [f"_p{h}_{q}" for h in range(HASHES) for q in range(HALF)]
_LANES = [f"_l{k}" for k in range(LANES)]


def _sums(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """For each row of texts, known by keys, the sum of the vectors of the paragraphs of a text column: _v (lanes, pieces, packed).
    Lines, then pieces, become rows of the same task, one line's pieces at a time."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x != "")
    lines = texts.select(*keys, F.explode_outer(lines).alias("_line"))
    pieces = F.regexp_extract_all("_line", F.lit(_PIECE), F.lit(1))
    rows = lines.select(*keys, "_line", F.posexplode_outer(pieces).alias("_at", "_piece"))
    out = [F.count("_piece").alias("_pieces")]
    for k, name in enumerate(_LANES):  # once a line
        out.append(F.sum(F.when(F.col("_at") == 0, F.xxhash64(F.lit(k), "_line").bitwiseAND(F.lit((1 << 32) - 1))).otherwise(F.lit(0))).alias(name))
    for h in range(HASHES):
        v = F.when(F.col("_piece").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(1000 + h), "_piece"))
        out += [F.sum(F.shiftright(v, q).bitwiseAND(F.lit(_ONES))).alias(f"_p{h}_{q}") for q in range(HALF)]
    lanes = F.array(*[F.col(x).bitwiseAND(F.lit((1 << 32) - 1)) for x in _LANES])
    made = F.struct(lanes.alias("lanes"), F.col("_pieces").alias("pieces"), F.array(*_PACKED).alias("packed"))
    return rows.groupBy(*keys).agg(*out).select(*keys, made.alias("_v"))


def _added(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of two multisets together, or of a without b."""
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit((1 << 32) - 1)))
    packed = F.zip_with(a["packed"], b["packed"], lambda x, y: x + F.lit(sign) * y)
    return F.struct(lanes.alias("lanes"), (a["pieces"] + F.lit(sign) * b["pieces"]).alias("pieces"), packed.alias("packed"))


def _hex(x: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(x)), width, "0")


def _shown(v: Column) -> Column:
    """A vector as a fingerprint: hex digits, 8 for a lane, 8 for the number of pieces and 16 for each pair of counters."""
    lanes, packed = F.transform(v["lanes"], lambda x: _hex(x, 8)), F.transform(v["packed"], lambda x: _hex(x, 16))
    return F.concat(F.array_join(lanes, ""), F.lit("."), _hex(v["pieces"], 8), F.lit("."), F.array_join(packed, ""))


def _parsed(fingerprint: Column) -> Column:
    number = lambda x: F.conv(x, 16, 10).cast("long")
    parts = F.split(fingerprint, r"\.")
    cut = lambda s, width, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: number(F.substring(s, i * width + 1, F.lit(width))))
    lanes, packed = cut(parts[0], 8, LANES), cut(parts[2], 16, len(_PACKED))
    return F.struct(lanes.alias("lanes"), number(parts[1]).alias("pieces"), packed.alias("packed"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a text of fingerprint a after insertion (sign 1) or deletion (sign -1) of the paragraphs of fingerprint b."""
    return _shown(_added(_parsed(a), _parsed(b), sign))


def _centred(v: Column) -> Column:
    one = lambda x, at: (F.shiftright(x, at).bitwiseAND(F.lit((1 << HALF) - 1)) * 2 - v["pieces"]).cast("double")
    return F.flatten(F.transform(v["packed"], lambda x: F.array(one(x, 0), one(x, HALF))))


def _likeness(a: str, b: str) -> Column:
    """0 to 1 for columns a (vector), ac (centred) and an (its norm), and those of b."""
    dot = F.aggregate(F.zip_with(f"{a}c", f"{b}c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norms = F.col(f"{a}n") * F.col(f"{b}n")
    cosine = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.when(norms > 0, norms)))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.coalesce(F.round(cosine, 6), F.lit(0.0)))


def _dealt(docs: DataFrame, n: int) -> DataFrame:
    """docs with _k, _bucket and _guest: ranges of doc_id, and the first row of each range once more, as guest at the end of the
    range before it (of the last range for the first). One shuffle then puts every row beside its successor; what the driver
    collects is two numbers a range."""
    keyed = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    cuts = keyed.agg(F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5], 10 * n)).head()[0] or []
    keyed = keyed.withColumn("_bucket", _place(F.col("_k"), sorted(set(cuts))))
    firsts = sorted((b, k) for b, k in keyed.groupBy("_bucket").agg(F.min("_k")).collect())
    if not firsts:
        return keyed.withColumn("_guest", F.lit(0))
    before = {k: firsts[i - 1][0] for i, (_, k) in enumerate(firsts)}  # the first one's is the last range
    host = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_k"))
    both = F.when(host.isNull(), F.array(F.col("_bucket"))).otherwise(F.array(F.col("_bucket"), host))
    dealt = keyed.withColumn("_host", both).select("*", F.posexplode("_host").alias("_guest", "_at"))
    return dealt.drop("_host", "_bucket").withColumnRenamed("_at", "_bucket")


def _place(key: Column, cuts: list[int]) -> Column:
    """How many of cuts, which are in order, key has reached: first among every m-th of them, then among the m from there."""
    if not cuts:
        return F.lit(0)
    m = math.isqrt(len(cuts)) + 1
    blocks = [cuts[i : i + m] for i in range(0, len(cuts), m)]
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    reached = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    block = reached(numbers([b[0] for b in blocks]))
    inside = F.get(F.split(F.lit(";".join(",".join(map(str, b)) for b in blocks)), ";"), block - 1)
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * m + reached(F.split(inside, ",").cast("array<bigint>")))


def paragraph_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs (doc_id, text), one by one; rows of the same doc_id are one multiset of paragraphs.
    Null text is empty; an empty table gives an empty result."""
    return _sums(docs.select("doc_id", whole("text").alias("_text")), ["doc_id"], "_text").select("doc_id", _shown(F.col("_v")).alias("fingerprint"))


def fingerprints(docs: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """For each document of (doc_id, text, ...): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next document by
    doc_id (after the last comes the first; a null doc_id is the smallest; rows of the same doc_id follow each other by text). Null
    text is empty. Empty texts have equal fingerprints; the likeness of an empty to another text is 0. Other columns are not carried,
    whatever their names. A table of one row is its own successor; an empty table gives an empty result.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files; none are read
    known = size // RANGE if size < 1 << 60 else 0  # beyond that it is a plan without statistics
    n = n_ranges or max(shuffle_partitions(docs.sparkSession), min(RANGES, known))
    dealt = _dealt(docs.select("doc_id", whole("text").alias("text")), n)
    order = Window.partitionBy("_bucket").orderBy("_guest", "_k", "text")
    near = dealt.withColumn("_next", F.lead("text").over(order)).withColumn("_row", F.row_number().over(order))
    near = near.withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    kept = (F.col("n_chars") - tail).cast("int")
    near = near.withColumn("_kept", F.substring("text", F.lit(1), kept)).withColumn("_end", F.substring(F.coalesce("_next", F.lit("")), F.lit(1), tail))
    # The paragraph of the cut begins after the last line break of what is kept: before it the texts agree.
    near = near.withColumn("_head", F.substring_index("_kept", "\n", -1))
    same = (F.length("_kept") - F.length("_head")).cast("int")
    segments = F.array(F.substring("text", F.lit(1), same), F.substring("text", same + 1, F.length("text")), F.concat("_head", "_end"))
    facts = ["_bucket", "_row", "_e", "_guest", "doc_id", "n_chars", "_sha"]
    sha = F.sha2(F.concat("_kept", "_end"), 256).alias("_sha")
    each = near.select("_bucket", "_row", "_guest", "doc_id", "n_chars", sha, F.posexplode(segments).alias("_e", "_t"))
    # All that follows is grouped and ordered within the ranges the rows are already dealt by: no further shuffle.
    rows = _sums(each, facts, "_t")
    both = Window.partitionBy("_bucket").orderBy("_row", "_e")
    for i in range(1, 5):
        rows = rows.withColumn(f"_v{i}", F.lead("_v", i).over(both))
    rows = rows.filter((F.col("_e") == 0) & (F.col("_guest") == 0))
    rows = rows.withColumn("_f", _added(F.col("_v"), F.col("_v1"))).withColumn("_ef", _added(F.col("_v"), F.col("_v2")))
    rows = rows.withColumn("_nf", _added(F.col("_v3"), F.col("_v4")))
    for f in ("_f", "_ef", "_nf"):
        rows = rows.withColumn(f"{f}c", _centred(F.col(f)))
    for f in ("_f", "_ef", "_nf"):
        rows = rows.withColumn(f"{f}n", F.sqrt(F.aggregate(f"{f}c", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.select(
        "doc_id", "n_chars", F.col("_sha").alias("edited_sha256"), _shown(F.col("_f")).alias("fingerprint"), _shown(F.col("_ef")).alias("edited_fingerprint"),
        _likeness("_f", "_ef").alias("near_edited"), _likeness("_f", "_nf").alias("near_next"),
    )


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
