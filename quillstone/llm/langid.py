"""Language identification by interpolated Kneser-Ney character models.

One trigram model a language, over lower-cased letters with every run of other
characters as one blank. The n-grams of all languages are packed into 64-bit keys
and kept as sorted arrays with a row of log probabilities, a column a language, so
that one search of a key serves all languages. The language with the lowest
cross-entropy a character wins; a document is rejected if that is above the limit of
that language, calibrated on documents the models haven't seen.

The models are fitted on a bounded sample: about SAMPLE documents of each language,
chosen by a hash of the id, and as many others calibrate the limit. A language of at
most 2 * SAMPLE documents is halved for the calibration: models of the lower half judge
the upper half, and the final models still learn from SAMPLE documents, or all there are.
What the driver collects and broadcasts is bounded by the sample: the distinct n-grams of at
most SAMPLE whole documents a language, of at most LANGS languages.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from .common import slices, table, whole

SAMPLE = 400
#: More languages than these are refused with an error, not dropped.
LANGS = 1000
DISCOUNT = 0.75
#: The limit of rejection: this quantile of the calibration's cross-entropies times MARGIN.
QUANTILE, MARGIN = 0.999, 1.2
_LETTER = None


def letters(text: str) -> np.ndarray:
    """Code points of text: lower case, runs of anything but letters as one blank, blanks at both ends. Empty if there is no letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x10000)])
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if (codes >= 0x10000).any():
        is_letter = np.array([c.isalpha() for c in low], bool)
    else:
        is_letter = _LETTER[codes]
    if not is_letter.any():
        return codes[:0]
    codes = np.concatenate([[np.uint64(32)], np.where(is_letter, codes, np.uint64(32)), [np.uint64(32)]]).astype(np.uint64)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def _pack(*parts: np.ndarray) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        out = (out << np.uint64(21)) | p
    return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    """langs; for n = 1, 2, 3 sorted keys and log probabilities; for contexts of 1 and 2 sorted keys and log back-off weights."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        mask, d = (1 << 21) - 1, DISCOUNT
        chars = {g & mask for c in counts.values() for g in c} or {32}
        p1s, p2s, p3s, b1s, b2s = [], [], [], [], []
        for lang in self.langs:
            c3 = counts[lang]
            c2 = Counter(g & (mask << 21 | mask) for g in c3)  # by distinct predecessors
            c1 = Counter(g & mask for g in c2)
            n1 = sum(c1.values()) or 1
            left = d * len(c1) / n1
            p1 = {c: max(c1.get(c, 0) - d, 0) / n1 + max(left, 1e-9) / (len(chars) + 1) for c in [*chars, 0]}
            t2, k2, t3, k3 = Counter(), Counter(), Counter(), Counter()
            for g, n in c2.items():
                t2[g >> 21] += n
                k2[g >> 21] += 1
            for g, n in c3.items():
                t3[g >> 21] += n
                k3[g >> 21] += 1
            b1 = {h: d * k2[h] / t2[h] for h in t2}
            p2 = lambda g, c2=c2, t2=t2, b1=b1, p1=p1: max(c2.get(g, 0) - d, 0) / t2[g >> 21] + b1[g >> 21] * p1[g & mask] if g >> 21 in t2 else p1[g & mask]
            b2 = {h: d * k3[h] / t3[h] for h in t3}
            low = lambda g: g & (mask << 21 | mask)
            p3 = lambda g, c3=c3, t3=t3, b2=b2, p2=p2: max(c3.get(g, 0) - d, 0) / t3[g >> 21] + b2[g >> 21] * p2(low(g)) if g >> 21 in t3 else p2(low(g))
            p1s.append(p1), p2s.append(p2), p3s.append(p3), b1s.append(b1), b2s.append(b2)
        every = sorted({g for c in counts.values() for g in c})
        self.k3, self.v3 = self._table(every, p3s)
        self.k2, self.v2 = self._table(sorted({low for g in every for low in [g & (mask << 21 | mask)]}), p2s)
        self.k1, self.v1 = self._table(sorted({*chars, 0}), [p.__getitem__ for p in p1s])
        self.h1, self.w1 = self._table(sorted({h for b in b1s for h in b}), [lambda h, b=b: b.get(h, 1.0) for b in b1s])
        self.h2, self.w2 = self._table(sorted({h for b in b2s for h in b}), [lambda h, b=b: b.get(h, 1.0) for b in b2s])
        self.limits = np.full(len(self.langs), np.inf)

    @staticmethod
    def _table(keys, columns):
        return np.array(keys or [0], np.uint64), np.log(np.array([[f(k) for f in columns] for k in keys] or [[1.0] * len(columns)]))

    def cross_entropies(self, codes: np.ndarray) -> np.ndarray:
        """For each language, nats a character; codes as from letters()."""
        a, b, c = codes[:-2], codes[1:-1], codes[2:]
        at, ok = _find(self.k3, _pack(a, b, c))
        total = self.v3[at[ok]].sum(axis=0)
        if not ok.all():
            a, b, c = a[~ok], b[~ok], c[~ok]
            at, has = _find(self.h2, _pack(a, b))
            total = total + self.w2[at[has]].sum(axis=0)
            at, ok2 = _find(self.k2, _pack(b, c))
            total = total + self.v2[at[ok2]].sum(axis=0)
            b, c = b[~ok2], c[~ok2]
            at, has = _find(self.h1, b)
            total = total + self.w1[at[has]].sum(axis=0)
            at, has = _find(self.k1, c)
            total = total + self.v1[np.where(has, at, 0)].sum(axis=0)
        return -total / len(codes[2:])

    def judge(self, text: str) -> tuple[str, float, float, bool]:
        """Language, score, cross-entropy and whether it is rejected."""
        codes = letters(text)
        if not len(codes) or not self.langs:
            return "und", 0.0, float("inf"), True
        ce = self.cross_entropies(codes)
        best = int(ce.argmin())  # a tie goes to the first language by name
        score = float(1 / np.exp(-(ce - ce[best]) * min(len(codes), 100)).sum())
        return self.langs[best], score, float(ce[best]), bool(ce[best] > self.limits[best])


def fit(docs, may_learn=None, sample: int = SAMPLE) -> Model:
    """A model of docs (doc_id, text, lang). may_learn: a condition; rows without lang or text never teach. Rows are chosen by a hash of
    their id, so that repeated rows teach together; rows with a null id are chosen alike. Without any row to learn from, as in an empty
    table, every document is und. A language that nothing can calibrate, as with a single document, has the greatest limit of the
    others, and none if there is no other. Other columns play no part, whatever their names."""
    taught = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    taught = taught.filter(may_learn) if may_learn is not None else taught
    at = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sizes = {r.lang: (r.n, r.mid) for r in taught.groupBy("lang").agg(F.count("*").alias("n"), F.percentile_approx(at, 0.5).alias("mid")).collect()}
    if not sizes:
        return Model({})
    if len(sizes) > LANGS:
        raise ValueError(f"{len(sizes)} languages, of at most {LANGS}")
    by_lang = lambda f: F.element_at(F.create_map(*[F.lit(x) for lang, of in sizes.items() for x in (lang, float(f(*of)))]), F.col("lang"))
    # Below half: learnt by all models; from there to twice the share: for the calibration; below share: learnt by the final models.
    half = by_lang(lambda n, mid: sample / n if n > 2 * sample else mid + 0.5 / (1 << 30))
    share = by_lang(lambda n, _: sample / n)

    def grams(batches):
        for batch in batches:
            seen: dict[tuple[str, bool], Counter] = {}
            for text, *group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = letters(text)
                if len(codes):
                    keys, n = np.unique(_pack(codes[:-2], codes[1:-1], codes[2:]), return_counts=True)
                    seen.setdefault(tuple(group), Counter()).update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
            rows = [(*g, k, n) for g, c in seen.items() for k, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64(), pa.int64()))], ["lang", "low", "gram", "n"])

    chosen = taught.select("text", "lang", (at < half).alias("low"), (at < share).alias("learnt"), (at < 2 * share).alias("near"))
    counted = chosen.filter("low or learnt").select("text", "lang", "low").mapInArrow(grams, "lang string, low boolean, gram bigint, n bigint").groupBy("lang", "low", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter] = {}
    lows: dict[str, Counter] = {}
    for lang, low, gram, n in counted.collect():  # bounded by the sample
        for c in (counts, lows) if low else (counts,):
            c.setdefault(lang, Counter())[gram] += n
    model = Model(counts)
    judge = model if lows == counts else Model(lows)
    others = chosen.filter("near and not low").filter(F.col("lang").isin(judge.langs))  # a language that judge lacks would only raise the limit
    judged = predict(others.select(F.lit(0).cast("long").alias("doc_id"), "text"), judge).filter("lang_pred <> 'und'")
    limits = dict(judged.groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", QUANTILE)).collect())  # one row a language
    if limits:
        greatest = max(limits.values())
        model.limits = np.array([limits.get(lang, greatest) * MARGIN for lang in model.langs])
    return model


def _shared(docs, model: Model):
    """The model for the executors, with its class: they need no copy of this package."""
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))


def predict(docs, model: Model):
    """doc_id, lang_pred, score, cross_entropy, rejected for each row of docs (doc_id, text). A text that is null or has no letter is und,
    with score 0, and rejected. Every row is judged by its text alone, whole: repeated rows, and rows with a null id, alike. Other columns
    are not carried, whatever their names. An empty table gives an empty result."""
    shared = _shared(docs, model)  # bounded by the sample that it was fitted on

    def run(batches):
        m = pickle.loads(shared.value)
        for batch in slices(batches):
            made = [m.judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in made], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_())))], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs, model: Model):
    """The rows of docs whose language is recognised, all columns as they are."""
    shared, at = _shared(docs, model), docs.columns.index("text")

    def run(batches):
        m = pickle.loads(shared.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([not m.judge(t or "")[3] for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op10_language_id(spark, sf_dir: str):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out())
    return predict(docs, model).withColumn("held_out", held_out())
