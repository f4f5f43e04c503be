"""Quality classifier: a small convolutional network over bytes, trained and run in numpy.

Bytes are embedded, learned filters of `width` bytes slide over the whole document
in steps of `stride`, and their rectified answers are max-pooled over overlapping
chunks of 2 * `half` steps (each half belongs to two chunks), so no byte is left
out. A document's chunks are combined by their mean and their maximum into one
logistic probability that its label is 1. In scoring, embedding and filters are
multiplied out beforehand into a table of answers per byte value and place.

Training runs on the driver, on a bounded sample: at most `per_class` labelled
documents of each class, those with the smallest hash of their id, and of these
only texts of at most `max_text` bytes. Everything else covers all documents: each
text is scored whole, in the tasks, with the weights as a broadcast of fixed size.

Defined cases: null text is empty; empty texts get the answer to one chunk of
padding; without a labelled document of either class nothing is known against a
document and every score is 1; several labels of one doc_id count as the smallest;
null labels and null ids are no labels. Of rows that share a doc_id the least text in
order is learned from; each row is scored by itself. Other columns pass through `keep`
and are ignored otherwise; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ranges, slices, texts_of

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
PAD = 256


@dataclass(frozen=True)
class Shape:
    width: int = 8
    stride: int = 4
    half: int = 32
    embedding: int = 4
    filters: int = 16


def held_out(folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


class Net:
    def __init__(self, shape: Shape, seed: int = 7):
        r = np.random.default_rng(seed)
        self.shape = shape
        s = shape
        self.p = {
            "embed": r.normal(0, 0.5, (257, s.embedding)),
            "filter": r.normal(0, 1 / np.sqrt(s.width * s.embedding), (s.width, s.embedding, s.filters)),
            "bias": np.zeros(s.filters),
            "out": r.normal(0, 0.1, 2 * s.filters),
            "out_bias": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.constant: float | None = None

    def layout(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte codes of the padded documents, halves per document, and the first code of every filter place.

        A document has steps at 0, stride, ... until all bytes are covered, filled up to whole halves, at least two.
        """
        s = self.shape
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        steps = np.maximum(-(-np.maximum(lengths - s.width, 0) // s.stride) + 1, 1)
        halves = np.maximum(-(-steps // s.half), 2)
        room = halves * s.half * s.stride + s.width
        at = np.cumsum(room) - room
        codes = np.full(int(room.sum()), PAD, np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        codes[ranges(at, lengths)] = raw
        return codes, halves, np.repeat(at, halves * s.half) + s.stride * ranges(np.zeros(len(texts), np.int64), halves * s.half)

    def answers(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        tables = (self.p["embed"] @ self.p["filter"]).astype(np.float32)  # width x 257 x filters
        out = np.take(tables[0], codes[place], axis=0)
        for j in range(1, self.shape.width):
            out += np.take(tables[j], codes[place + j], axis=0)
        out += self.p["bias"]
        return np.maximum(out, 0, out=out)

    def pooled(self, texts: list[bytes], for_training: bool = False):
        s = self.shape
        codes, halves, place = self.layout(texts)
        a = self.answers(codes, place).reshape(-1, s.half, s.filters)
        top = a.max(1)
        first = np.cumsum(halves) - halves
        chunk_first = first - np.arange(len(texts))  # a document of n halves has n - 1 chunks
        inner = np.ones(len(top), bool)
        inner[first + halves - 1] = False
        left = np.flatnonzero(inner)
        chunk = np.maximum(top[left], top[left + 1])
        mean = np.add.reduceat(chunk, chunk_first) / (halves - 1)[:, None]
        high = np.maximum.reduceat(chunk, chunk_first)
        features = np.concatenate([mean, high], 1)
        if not for_training:
            return features
        which_half = left[:, None] + (top[left + 1] > top[left])
        step = np.take_along_axis(a.argmax(1), which_half, 0)
        at = place.reshape(-1, s.half)[which_half, step]  # code where each chunk's answer comes from
        return features, (codes, halves - 1, chunk, high, at)

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.p["out"] + self.p["out_bias"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: list[bytes], run_bytes: int = 1 << 17) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, at, size = [], 0, 0
        for i, t in enumerate([*texts, b""]):
            if i > at and (i == len(texts) or size + len(t) > run_bytes):
                out.append(self.probability(self.pooled(texts[at:i])))
                at, size = i, 0
            size += len(t) + 2 * self.shape.half * self.shape.stride
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        s = self.shape
        features, (codes, chunks, chunk, high, at) = self.pooled(texts, True)
        d = ((self.probability(features) - y) * weight / weight.sum()).astype(np.float32)
        g = {"out": features.T @ d, "out_bias": d.sum(keepdims=True)}
        back = d[:, None] * self.p["out"]
        doc = np.repeat(np.arange(len(texts)), chunks)
        d_chunk = back[doc, : s.filters] / chunks[doc, None]
        is_high = chunk == high[doc]
        first = np.cumsum(chunks) - chunks
        d_chunk += np.where(is_high, back[doc, s.filters :] / np.maximum(np.add.reduceat(is_high.astype(np.float32), first), 1)[doc], 0)
        d_chunk *= chunk > 0
        g["bias"] = d_chunk.sum(0)
        g["filter"], g["embed"] = np.zeros_like(self.p["filter"]), np.zeros_like(self.p["embed"])
        column = np.arange(s.filters)
        for j in range(s.width):
            index = codes[at + j] * s.filters + column
            table = np.bincount(index.ravel(), d_chunk.ravel(), 257 * s.filters).reshape(257, s.filters).astype(np.float32)
            g["filter"][j] = self.p["embed"].T @ table
            g["embed"] += table @ self.p["filter"][j].T
        return g


def fit(texts: list[bytes], labels: np.ndarray, prior: float, shape: Shape = Shape(), epochs: int = 12, size: int = 48, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the weighted logistic loss; prior: the share of label 1 that the sample's classes are weighted to."""
    net = Net(shape, seed)
    if not len(labels) or labels.min() == labels.max():
        net.constant = 1.0
        return net
    share = labels.mean()
    weight = np.where(labels == 1, prior / share, (1 - prior) / (1 - share))
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    t, total = 0, epochs * -(-len(texts) // size)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for a in range(0, len(order), size):
            some = order[a : a + size]
            g = net.gradients([texts[i] for i in some], labels[some], weight[some])
            t += 1
            lr = rate * (1 - t / (total + 1))
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                net.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, per_class: int = 1000, max_text: int = 1 << 15, shape: Shape = Shape(), epochs: int = 12) -> Net:
    """A net from labels(doc_id, quality) of rows outside the held-out fold: at most `per_class` ids of each label, one text an id (of repeated rows the least in order)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(~held_out(folds, fold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(per_class)
        sample = part if sample is None else sample.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= max_text)
    picked = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text")).orderBy("id")  # a text an id, at most 2 * per_class ids
    rows = picked.collect()
    n = sum(counts.values())
    return fit([r["text"].encode() for r in rows], np.array([r["label"] for r in rows], np.int64), counts.get(1, 0) / n if n else 1.0, shape, epochs)


def scored(docs: DataFrame, net: Net, name: str = "score") -> DataFrame:
    """docs with a column of scores."""


    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = [n.lower() for n in b.schema.names].index("text")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(texts_of(b.column(at))), pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted per document."""
    net = train(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), net)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't rejected."""


    name = fresh(docs.columns, "score")
    return scored(docs, train(docs, labels), name).where(F.col(name) >= threshold).drop(name)
