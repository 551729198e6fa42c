"""Operator 2: quality classifier, a convolutional network over bytes in numpy.

Each byte has a learned vector of ``DIM`` numbers; ``FILTERS`` learned filters slide over ``WIDTH`` bytes at a time. The
largest answer of each filter is taken per hop of ``HOP`` bytes and per chunk of two hops, so chunks overlap by half and
cover the whole text; a text's features are the mean and the maximum over its chunks, and a logistic unit makes one
probability of them.

The network is trained on the driver with Adam on at most ``ROWS_PER_CLASS`` labelled rows of either class (those with the
smallest hash of the id, held-out rows excluded), of which only the first count whose texts together stay within
``BYTES_PER_CLASS``. Their texts are whole, so that training and scoring have the same features; the driver holds no more than
those bytes, whatever the size of the input. Scoring reads every text whole, one pass without a shuffle.

Null text: empty. Empty texts have no chunk and get the score of zero features. Rows are scored by themselves, so repeated
rows agree. Labels that are null do not count; of several labels of an id the largest does, of several texts of a labelled id
the smallest. Without both classes among the labels every score is the share of label 1 with one half added to either side. An
empty table gives an empty result. Columns other than doc_id, text and quality are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearmark.llm.common import Steps, slices, texts_of

DIM, WIDTH, FILTERS, HOP = 6, 10, 32, 256
STRIDE = 2
BLOCK_HOPS, ROWS_PER_CLASS, BYTES_PER_CLASS = 1024, 1500, 128 << 20
STEPS, BATCH_DOCS, RATE, SEED = 400, 32, 0.01, 11
THRESHOLD = 0.3


def held_out(doc_id, folds: int = 5):
    """Whether the remainder of the crc32 of the id's text is 0; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


class ByteCnn:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.filters = rng.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weights = np.zeros(2 * FILTERS, np.float32)
        self.bias = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.shift, self.weights, self.bias]

    def hops(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hop of padded texts the largest answer of each filter, and the window that gave it; ``BLOCK_HOPS`` at a time."""
        per = HOP // STRIDE
        hops = (len(data) - WIDTH + STRIDE) // HOP
        top, where = np.empty((hops, FILTERS), np.float32), np.empty((hops, FILTERS), np.uint8)
        for lo in range(0, hops, BLOCK_HOPS):
            n = min(BLOCK_HOPS, hops - lo)
            x = self.table[data[lo * HOP:(lo + n) * HOP + WIDTH - STRIDE]]
            windows = np.lib.stride_tricks.as_strided(x, (n * per, WIDTH * DIM), (STRIDE * DIM * 4, 4))
            out = (windows @ self.filters).reshape(n, per, FILTERS)
            top[lo:lo + n], where[lo:lo + n] = out.max(axis=1), out.argmax(axis=1)
        return top, where

    def features(self, texts: list[bytes], back: bool = False):
        """Features (texts, 2 * FILTERS); with ``back`` also what a backward step needs."""
        lengths = [-(-len(t) // HOP) for t in texts]
        if not sum(lengths):
            return np.zeros((len(texts), 2 * FILTERS), np.float32), None
        data = np.frombuffer(b"".join(t.ljust(n * HOP, b"\0") for t, n in zip(texts, lengths, strict=True)) + bytes(WIDTH), np.uint8)
        top, where = self.hops(data[:sum(lengths) * HOP + WIDTH - STRIDE])
        top = top + self.shift
        first = np.concatenate([[0], np.cumsum(lengths)])
        last = np.zeros(len(top), bool)
        last[[e - 1 for e, n in zip(first[1:], lengths, strict=True) if n]] = True
        follow = np.where(last, np.arange(len(top)), np.arange(1, len(top) + 1))  # a text's last hop ends its last chunk
        chunk = np.maximum(top, top[np.minimum(follow, len(top) - 1)])
        used = [k for k, n in enumerate(lengths) if n]
        start = first[:-1][used]
        mean = np.add.reduceat(chunk, start, axis=0) / np.array(lengths)[used][:, None]
        most = np.maximum.reduceat(chunk, start, axis=0)
        out = np.zeros((len(texts), 2 * FILTERS), np.float32)
        out[used] = np.concatenate([mean, most], axis=1)
        if not back:
            return out, None
        return out, (data, where, top, follow, chunk, used, start, np.array(lengths), most)

    def score(self, texts: list[bytes]) -> np.ndarray:
        f, _ = self.features(texts)
        return 1 / (1 + np.exp(-(f.astype(np.float64) @ self.weights.astype(np.float64) + float(self.bias[0]))))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        f, kept = self.features(texts, back=True)
        p = 1 / (1 + np.exp(-(f @ self.weights + self.bias)))
        d = ((p - labels) / len(texts)).astype(np.float32)
        grads = [np.zeros_like(x) for x in self.params()]
        grads[3], grads[4] = f.T @ d, d.sum(keepdims=True)
        if kept is None:
            return grads
        data, where, top, follow, chunk, used, start, lengths, most = kept
        df = d[used][:, None] * self.weights
        doc = np.repeat(np.arange(len(used)), lengths[used])
        equal = (chunk == most[doc]).astype(np.float32)
        dchunk = df[doc, :FILTERS] / lengths[used][doc][:, None] + df[doc, FILTERS:] * equal / np.add.reduceat(equal, start, axis=0)[doc]
        nxt = np.minimum(follow, len(top) - 1)
        own = top >= top[nxt]
        dtop = np.where(own, dchunk, 0)
        np.add.at(dtop, nxt, np.where(own, 0, dchunk))
        grads[2] = dtop.sum(axis=0)
        for k in range(FILTERS):
            hop = np.flatnonzero(dtop[:, k])
            g = dtop[hop, k]
            at = hop * HOP + where[hop, k].astype(np.int64) * STRIDE
            seen = data[at[:, None] + np.arange(WIDTH)]  # (hits, WIDTH) bytes under each winning window
            grads[1][:, k] = g @ self.table[seen].reshape(len(g), WIDTH * DIM)
            hits = np.zeros((WIDTH, 256))
            for i in range(WIDTH):
                hits[i] = np.bincount(seen[:, i], g, 256)
            grads[0] += (hits.T @ self.filters[:, k].reshape(WIDTH, DIM)).astype(np.float32)
        return grads


def train(texts: list[bytes], labels: list[int], steps: int = STEPS, seed: int = SEED) -> ByteCnn:
    """Adam on batches with as many rows of either class."""
    net, rng = ByteCnn(seed), np.random.default_rng(seed)
    y = np.array(labels)
    sides = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
    m, v = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for t in range(1, steps + 1):
        pick = np.concatenate([rng.choice(s, BATCH_DOCS // 2) for s in sides])
        rate = RATE * min(1, 2 * (1 - t / (steps + 1)))
        for p, g, a, b in zip(net.params(), net.gradients([texts[i] for i in pick], y[pick]), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
    return net


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS,
                  bytes_per_class: int = BYTES_PER_CLASS) -> tuple[list[bytes], list[int]]:
    """The training sample, a bounded number of rows and bytes: whole texts and labels, on the driver."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).withColumn("_o", F.xxhash64("doc_id", F.lit(SEED)))
    some = [known.where(F.col("quality") == q).orderBy("_o", "doc_id").limit(rows_per_class) for q in (0, 1)]
    picked = some[0].unionByName(some[1]).select("doc_id", "_o", F.col("quality").cast("int").alias("_q"))

    found = texts_of(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_o", "_q").agg(F.min(F.col("text").cast("binary")).alias("raw"))
    found = Steps(docs.sparkSession, "sample")(found)
    held = F.sum(F.octet_length("raw")).over(Window.partitionBy("_q").orderBy("_o", "doc_id"))  # of at most rows_per_class rows
    fits = found.select("doc_id", held.alias("held")).where(F.col("held") <= bytes_per_class)
    found = found.join(fits, "doc_id", "left_semi").select("doc_id", "raw", "_q").toPandas().sort_values("doc_id")
    return [bytes(x) for x in found["raw"]], found["_q"].tolist()


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    texts, y = training_rows(docs, labels)
    both = 0 < sum(y) < len(y)
    net = train(texts, y) if both else None
    share = (sum(y) + 0.5) / (len(y) + 1)

    def run(batches):
        for b in slices(batches, 1 << 18):
            raw = [t.encode() for t in b.column("text").to_pylist()]
            score = net.score(raw) if net else np.full(len(raw), share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    d = texts_of(docs)
    out = d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
