"""Quality classifier: a convolutional network over bytes, in numpy.

Bytes are embedded; filters of WIDTH bytes run over the whole text at every STRIDE bytes. What a filter finds is max-pooled over blocks,
and over chunks of SPAN blocks that overlap by half. A hidden layer judges each chunk; the mean and the maximum of the judgements over all
chunks of a document give one probability. So a text costs time in proportion to its length, and none of it is left out.

The network is trained in one task, on a bounded sample of labelled documents; chunks pass their gradient only to the windows that won the
maximum, so a step backwards costs little.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, whole

WIDTH, STRIDE = 8, 4  # of a filter, in bytes
BLOCK, SPAN = 32, 6  # bytes of a block, blocks of a chunk
DIM, FILTERS, HIDDEN = 8, 40, 24
#: Documents of each label to learn from, at most, and their bytes: longer texts lend as many bytes in LEND stretches, evenly spaced.
SAMPLE, TAUGHT, LEND = 2000, 4 << 10, 8
STEPS, BATCH, RATE, DECAY, SMOOTH = 1000, 32, 4e-3, 0.01, 0.002  # SMOOTH: labels are taught as so much off 0 and 1
THRESHOLD = 0.3
_SLICE = 1 << 20
_PER = BLOCK // STRIDE  # windows of a block


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each padded with zeros to whole blocks (one at least), and the blocks of each."""
    blocks = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    out = np.zeros(int(blocks.sum()) * BLOCK, np.uint8)
    for t, at in zip(texts, ((np.cumsum(blocks) - blocks) * BLOCK).tolist(), strict=True):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
    return out, blocks


def chunks_of(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First blocks of the chunks of all texts, and how many each has: a chunk starts at every SPAN / 2 blocks, until one reaches the end."""
    n = np.maximum(1, -(-(blocks - SPAN) // (SPAN // 2)) + 1)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(blocks) - blocks, n) + place * (SPAN // 2), n


class Network:
    """Weights, forward and backward pass. Byte 0 pads: its embedding is zero."""

    def __init__(self, seed: int = 12):
        r = np.random.default_rng(seed)
        f = lambda *s, by: (r.standard_normal(s) * by).astype(np.float32)
        self.w = {
            "emb": f(256, DIM, by=0.5), "conv": f(WIDTH * DIM, FILTERS, by=0.18), "bias": np.zeros(FILTERS, np.float32),
            "a": f(FILTERS, HIDDEN, by=0.25), "b": np.full(HIDDEN, 0.1, np.float32), "out": f(2 * HIDDEN, by=0.25), "shift": np.zeros(1, np.float32),
        }
        self.w["emb"][0] = 0
        self.prior = 0.0

    def blocks(self, raw: np.ndarray, blocks: np.ndarray, where: bool = False):
        """Maxima of all filters in each block, and the windows where they are if asked. A window spans two strides, so it is the sum of
        two products over the same bytes; the last of a text reaches into padding only."""
        x = self.w["emb"][raw].reshape(-1, STRIDE * DIM)
        half = STRIDE * DIM
        y, later = x @ self.w["conv"][:half], x @ self.w["conv"][half:]
        later[(np.cumsum(blocks) - blocks) * _PER] = 0  # the first stride of a text follows no window of its own
        y[:-1] += later[1:]
        y = y.reshape(-1, _PER, FILTERS)
        return y.max(axis=1), y.argmax(axis=1) if where else None

    def forward(self, raw: np.ndarray, blocks: np.ndarray, where: bool = False) -> dict:
        top, at = self.blocks(raw, blocks, where)
        first, n = chunks_of(blocks)
        ends = np.repeat(np.cumsum(blocks), n)
        of = np.minimum(first[:, None] + np.arange(SPAN), ends[:, None] - 1)
        pooled = top[of[:, 0]]
        for j in range(1, SPAN):
            np.maximum(pooled, top[of[:, j]], out=pooled)
        m = np.maximum(pooled + self.w["bias"], 0)
        h = np.maximum(m @ self.w["a"] + self.w["b"], 0)
        starts = np.cumsum(n) - n
        d = np.concatenate([np.add.reduceat(h, starts) / n[:, None], np.maximum.reduceat(h, starts)], axis=1)
        z = d @ self.w["out"] + self.w["shift"]
        return {"top": top, "at": at, "of": of, "m": m, "h": h, "n": n, "starts": starts, "d": d, "z": z}

    def gradient(self, raw: np.ndarray, blocks: np.ndarray, labels: np.ndarray) -> dict:
        w, s = self.w, self.forward(raw, blocks, where=True)
        n, docs = s["n"], len(labels)
        dz = (1 / (1 + np.exp(-s["z"])) - labels).astype(np.float32) / docs
        doc = np.repeat(np.arange(docs), n)
        dd = dz[:, None] * w["out"]
        dh = (dd[:, :HIDDEN] / n[:, None])[doc]
        best = s["h"] == s["d"][doc, HIDDEN:]
        dh += np.where(best, dd[doc, HIDDEN:] / np.add.reduceat(best, s["starts"], dtype=np.float32)[doc], 0)
        dh *= s["h"] > 0
        dm = (dh @ w["a"].T) * (s["m"] > 0)
        chunk, filt = np.nonzero(np.abs(dm) > 5e-3 * np.abs(dm).max())  # the rest moves nothing
        g = dm[chunk, filt]
        of = s["of"][chunk]
        block = of[np.arange(len(of)), s["top"][of, filt[:, None]].argmax(axis=1)]
        place = ((block * _PER + s["at"][block, filt]) * STRIDE)[:, None] + np.arange(WIDTH)
        seen = np.where(place < (np.cumsum(blocks) * BLOCK)[doc[chunk]][:, None], raw[np.minimum(place, len(raw) - 1)], 0)
        by = np.argsort(filt, kind="stable")
        x, f_at = w["emb"][seen].reshape(len(seen), -1)[by] * g[by, None], np.unique(filt[by], return_index=True)
        conv = np.zeros_like(w["conv"])
        if len(by):
            conv[:, f_at[0]] = np.add.reduceat(x, f_at[1]).T
        back = (w["conv"].T[filt] * g[:, None]).reshape(-1, DIM)
        emb = np.stack([np.bincount(seen.ravel(), back[:, i], 256) for i in range(DIM)], axis=1)
        emb[0] = 0
        return {
            "emb": emb, "conv": conv, "bias": dm.sum(0), "a": s["m"].T @ dh, "b": dh.sum(0), "out": s["d"].T @ dz, "shift": dz.sum(keepdims=True),
        }

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.forward(*laid_out(texts))["z"].astype(np.float64) + self.prior
        return np.round(1 / (1 + np.exp(-z)), 6)


class Constant:
    """Where one label, or none, is known: the share of label 1, smoothed."""

    def __init__(self, ones: int, zeros: int):
        self.share = (ones + 1) / (ones + zeros + 2)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def train(texts: list[bytes], labels: np.ndarray, ones: int, zeros: int, steps: int = STEPS, seed: int = 12):
    """The network learns from as many texts of either label in each step, moved by 0 to STRIDE - 1 bytes so that no place is special;
    the labels' true frequencies (ones, zeros) come back in as the prior."""
    if not ones or not zeros:
        return Constant(ones, zeros)
    net, r = Network(seed), np.random.default_rng(seed)
    net.prior = float(np.log(ones / zeros))
    by = [np.flatnonzero(labels == k) for k in (0, 1)]
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = np.concatenate([r.choice(b, BATCH // 2) for b in by])
        some = [b"\0" * int(k) + texts[i] for i, k in zip(chosen, r.integers(0, STRIDE, len(chosen)), strict=True)]
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for k, g in net.gradient(*laid_out(some), (labels[chosen] * (1 - 2 * SMOOTH) + SMOOTH).astype(np.float32)).items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.w[k] -= (rate * (DECAY * net.w[k] + (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, sample: int = SAMPLE):
    """A model of docs (doc_id, text) and labels (doc_id, quality 0 or 1).

    The labelled ids are chosen by a hash, `sample` of each label at most; rows without id or with another label don't teach, nor do ids
    with both labels. may_learn is a condition on doc_id. With one label only, or none, as in an empty table, the model is a constant.
    """
    known = labels.select("doc_id", "quality").filter("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.filter(may_learn) if may_learn is not None else known
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_max")).filter("quality = _max").drop("_max")
    sizes = dict(known.groupBy("quality").count().collect())  # two rows
    order = [F.xxhash64(F.lit(12), "doc_id"), "doc_id"]
    chosen = known.filter("quality = 0").orderBy(*order).limit(sample).union(known.filter("quality = 1").orderBy(*order).limit(sample))

    def lent(batches):
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                raw = t.encode()
                if len(raw) > TAUGHT:
                    part = TAUGHT // LEND
                    raw = b"".join(raw[a : a + part] for a in (i * (len(raw) - part) // (LEND - 1) for i in range(LEND)))
                out.append(raw)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "quality", "raw"])

    kind = labels.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    taught = texts.mapInArrow(lent, f"doc_id {kind}, quality int, raw binary").repartition(1).sortWithinPartitions(*order)

    def learn(batches):
        rows = [(t, q) for b in batches for t, q in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
        have = {q for _, q in rows}
        ones, zeros = (sizes.get(q, 0) if q in have else 0 for q in (1, 0))
        model = train([t for t, _ in rows], np.array([q for _, q in rows], np.int64), ones, zeros)
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(model)], pa.binary())], ["model"])

    made = taught.mapInArrow(learn, "model binary").first()
    return pickle.loads(made.model) if made else Constant(0, 0)


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, score (0 to 1: how likely label 1 is) and predicted (1 from THRESHOLD on) of each row of docs (doc_id, text).

    Every row is judged by its text alone, whole: repeated rows, and rows without id, alike. A null text counts as empty, and an empty text
    is scored as a block of padding. Other columns are not carried. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # some 20 kB

    def run(batches):
        m = pickle.loads(shared.value)
        for batch in batches:
            ids, scores, some, size = batch.column(0), [], [], 0
            for t in batch.column(1):
                raw = t.as_buffer().to_pybytes()
                if some and size + len(raw) > _SLICE:
                    scores.append(m.scores(some))
                    some, size = [], 0
                some.append(raw)
                size += len(raw) + BLOCK
            scores.append(m.scores(some) if some else np.zeros(0))
            made = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.float64()), pa.array(made >= THRESHOLD).cast(pa.int32())], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole("text").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def op12_quality_cnn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return predict(docs, model).withColumn("held_out", held_out())
