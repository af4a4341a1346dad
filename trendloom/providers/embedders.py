"""Text embeddings: distinct texts are encoded once."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Unit vectors of texts; has to be picklable."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedProjection:
    """Signed hashes of words and word pairs, summed by logarithmic counts and made unit vectors."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            ws = re.findall(r"\w+", text.lower())
            counts = Counter([*ws, *map(" ".join, zip(ws, ws[1:], strict=False))])  # in order of appearance
            h = np.frombuffer(b"".join([hashlib.blake2b(t.encode(), digest_size=8).digest() for t in counts]), "<u8")
            n = np.log1p(np.fromiter(counts.values(), dtype=float, count=len(counts)))
            np.add.at(row, (h % np.uint64(self.dim)).astype(np.intp), np.where(h >> np.uint64(63), n, -n))  # one after the other
            row /= max(float(np.linalg.norm(row)), 1e-12)
        return out


def embed(docs: DataFrame, embedder: Embedder | None = None, text: str = "text") -> DataFrame:
    """M1, O3: docs with a column embedding; each distinct text is encoded once; null counts as empty."""
    coder = embedder or HashedProjection()
    t = F.coalesce(F.col(text), F.lit(""))
    distinct = docs.select(t.alias("_t"), F.sha2(t, 256).alias("_h")).dropDuplicates(["_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = coder.encode(b.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"_h": b.column(1), "embedding": pa.array(list(v), pa.list_(pa.float32()))})

    coded = distinct.mapInArrow(run, "_h string, embedding array<float>")
    return docs.withColumn("_h", F.sha2(t, 256)).join(coded, "_h").drop("_h")
