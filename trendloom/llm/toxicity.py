"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import bounded_batches, drawn, fold, fresh, labelled_sample
from trendloom.plans.scratch import Scratch

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: log2 of the number of weights; labelled documents, and their slots in all, that a model learns from at most, about.
BITS, SAMPLE_DOCS, SAMPLE_SLOTS = 20, 16_384, 1 << 26
THRESHOLD = 0.3


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct slots of a text's words, word pairs and pairs that skip one word (A-Z lower-cased)."""
    ws = WORD.findall(text.encode("utf-8", "replace").lower()) if text else []
    if not ws:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(zlib.crc32, ws), dtype=np.uint64, count=len(ws))
    one = np.unique(h)
    mixed = [one * np.uint64(0x9E3779B97F4A7C15)]
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if len(h) > gap:
            mixed.append((h[:-gap] * np.uint64(0x9E3779B185EBCA87) + h[gap:]) * np.uint64(odd))
    return np.unique(np.concatenate(mixed) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate rates and L1: a weight stays zero until its gradients outweigh l1."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias = 0.0
        self._bias_n = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, y: float) -> None:
        """One example of binary features."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias, -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self._bias_n += g * g
        self.bias -= self.alpha / (self.beta + np.sqrt(self._bias_n)) * g


def train(examples: list[tuple[np.ndarray, float]], bits: int = BITS, epochs: int = 8) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots and values of the weights that aren't zero, and the bias, after ``epochs`` passes in the given order."""
    model = Ftrl(1 << bits)
    for _ in range(epochs):
        for at, y in examples:
            model.learn(at, y)
    w = model.weights()
    at = np.flatnonzero(w)
    return at, w[at], model.bias


def fit(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE_DOCS, bits: int = BITS, seed: int = 29, slots_held: int = SAMPLE_SLOTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns labels.toxic of about ``sample`` labelled documents where ``keep`` holds, in one task.

    That task holds the slots of the sample, 4 bytes each; a sample of very long texts is
    thinned by a second seeded hash, so that about ``slots_held`` slots are left. Ids may be of
    any type. What comes back are the weights that L1 left, at most 2**bits.
    """
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen, odds = labelled_sample(labels.select("doc_id", "toxic"), "toxic", keep, sample, seed)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("y").cast("double").alias("y"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, bits).astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "at": pa.array(found, pa.list_(pa.int32())), "y": b.column(2)})

    examples = scratch.save(rows.mapInArrow(slots, "id string, at array<int>, y double"), "examples")
    held = examples.agg(F.sum(F.size("at").cast("long"))).first()[0] or 0
    some = examples.where(drawn("id", min(1.0, slots_held / max(1, held)), seed + 1))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for b in batches:
            at = b.column(1)
            seen += [(i, at[k].values.to_numpy(zero_copy_only=False), y) for k, (i, y) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))]
        seen.sort(key=lambda x: (zlib.crc32(x[0].encode()), x[0], x[1].tobytes()))
        at, w, bias = train([x[1:] for x in seen], bits)
        yield pa.RecordBatch.from_pydict({"slot": pa.array([-1, *at.tolist()], pa.int64()), "w": pa.array([bias, *w.tolist()], pa.float64())})

    got = some.repartition(1).mapInArrow(learn, "slot long, w double").toPandas()
    scratch.drop(examples)
    bias = float(got.loc[got.slot < 0, "w"].sum())
    got = got[got.slot >= 0]
    return got.slot.to_numpy(), got.w.to_numpy(), bias + (odds if len(got) else 0.0)


def score_column(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS, text: str = "text") -> Column:
    """Probability that a whole text is toxic, with the sparse weights broadcast."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w, bias = shared.value
        dense = np.zeros(1 << bits)
        dense[at] = w
        for s in batches:
            yield pd.Series([float(1 / (1 + np.exp(-np.clip(dense[features(t, bits)].sum() + bias, -35, 35)))) for t in s], dtype=float)

    return score(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Labels of documents whose crc32(doc_id) mod parts is ``held`` aren't read. A null or empty
    text has no features and scores the bias alone; without any label every score is 0.5. Long
    texts are read whole; a score of just ``threshold`` counts as toxic.
    Repeated rows score the same each; null labels and null ids in labels teach nothing; an id
    with several labels counts as toxic if any is; other columns are ignored whatever their
    names; an empty table gives an empty one.
    """
    out = fold("doc_id", parts) == held
    score = score_column(docs, fit(docs, labels, ~out))
    s = fresh(docs, "score")
    scored = docs.select("doc_id", out.alias("held_out"), score.alias(s))
    return scored.select("doc_id", "held_out", F.col(s).alias("score"), (F.col(s) >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the documents that score ``threshold`` or more; learns from all labels.

    Null texts and texts without a word stay, as nothing in them is toxic, and so does every
    document if no weight was learnt. Repeated rows stay or go together; columns keep their names
    and values; an empty table gives an empty one.
    """
    s = fresh(docs, "score")
    at, w, bias = fit(docs, labels, F.lit(True))
    if not len(at):
        return docs
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    return docs.withColumn(s, score_column(docs, (at, w, bias))).where(wordless | (F.col(s) < threshold)).drop(s)
