"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text's tokens are its words and its single punctuation marks; its features are the hashes of tokens and of pairs of
neighbouring tokens (all pairs of a token with itself count as one feature), each with its share of all of them. Training reads a sample of at most `sample` labelled rows (a
documented bound: those with the smallest hash of their id), makes their sparse vectors on the executors and applies the
updates one by one on the driver. Scoring is a sparse dot product for each text, on the executors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import grouped, mapped, without

TOKEN = re.compile(r"\w+|[^\w\s]")
BITS, SAMPLE, EPOCHS = 18, 8_000, 3
#: Step size, its floor, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02
#: Shares of n-grams are small; this makes a text's features add up to it.
SCALE = 8.0
REMEMBERED = 100_000
#: The hash of a pair of one token with itself, whichever it is.
TWICE = np.uint32(0x7457494E)
ADDED = {"quality_score": T.DoubleType(), "quality_predicted": T.IntegerType()}


class Hasher:
    """Hashes of a text's n-grams; the hash of a token is remembered."""

    def __init__(self, bits: int):
        self.mask, self.known = np.uint32((1 << bits) - 1), {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text) if text else []
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        try:
            ids = np.fromiter(map(known.__getitem__, tokens), np.uint32, len(tokens))
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = zlib.crc32(t.encode())
            ids = np.fromiter(map(known.__getitem__, tokens), np.uint32, len(tokens))
        pairs = (ids[:-1] * np.uint32(0x9E3779B1)) ^ (ids[1:] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F))
        pairs[ids[:-1] == ids[1:]] = TWICE
        every = np.concatenate([ids, pairs])
        return (every ^ (every >> np.uint32(15))) & self.mask


class Model:
    """Weights of the n-grams, and of a constant."""

    def __init__(self, weights: np.ndarray, constant: float, bits: int):
        self.weights, self.constant, self.bits = weights, constant, bits

    def score(self, hashes: np.ndarray) -> float:
        z = self.constant + (SCALE * float(self.weights[hashes].sum()) / len(hashes) if len(hashes) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def trained(vectors: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """vectors: label, feature indices, values. Rows are taken in an order that depends on nothing but their number."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    w = np.zeros((1 << bits) + 1)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(vectors)):
            y, idx, val = vectors[i]
            idx, val = np.append(idx.astype(np.int64), 1 << bits), np.append(val.astype(np.float64) * SCALE, 1.0)
            zi, ni = z[idx], n[idx]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ val, -35, 35)))
            g = (p - y) * val
            z[idx] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n[idx] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def labelled(labels: DataFrame, label: str, key: str) -> DataFrame:
    """Each key with its label. Rows without key or label never count."""
    return labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias(label))


def sampled(labels: DataFrame, label: str, key: str, rows: int) -> DataFrame:
    """At most so many labelled rows: those with the smallest hash of their key."""
    return labelled(labels, label, key).orderBy(F.xxhash64(key), key).limit(rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Trained on the labelled rows given (leave held-out ones out beforehand). Without any, or without documents, the model scores
    every text 0.5. Of an id that docs have several times, each row counts; null texts count as empty ones."""
    few = F.broadcast(sampled(labels, label, key, sample))  # at most `sample` rows
    rows = docs.select(key, text).join(few, key).select(F.col(label).cast("int").alias("y"), F.xxhash64(text).alias("h"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in batches:
            for part in grouped(batch, 2):
                got = [np.unique(hasher(t), return_counts=True) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([i.astype("<u4").tobytes() for i, _ in got], pa.binary()), pa.array([(c / max(1, c.sum())).astype("<f4").tobytes() for _, c in got], pa.binary())], names=["y", "h", "i", "v"])

    got = mapped(rows, run, "y int, h long, i binary, v binary").toArrow().sort_by([("h", "ascending"), ("y", "ascending"), ("i", "ascending")])
    # Views into the table: the sample's vectors are on the driver once.
    vectors = [(y, np.frombuffer(i.as_buffer(), "<u4"), np.frombuffer(v.as_buffer(), "<f4")) for y, i, v in zip(got.column("y").to_pylist(), got.column("i"), got.column("v"), strict=True)]
    return trained(vectors, bits)


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with quality_score (0 to 1) and quality_predicted (1 from 0.5). A row out for each row in; null and empty texts get
    the constant's score; columns of those names are replaced."""
    df = without(df, ADDED)
    schema, at = T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in ADDED.items())]), df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast((model.weights.tobytes(), model.constant, model.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, constant, bits = shared.value
        own = Model(np.frombuffer(weights, np.float32), constant, bits)
        hasher = Hasher(bits)
        for batch in batches:
            for part in grouped(batch, at, 1_000_000):
                scores = [own.score(hasher(t)) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*part.schema.names, *ADDED])

    return mapped(df, run, schema)
