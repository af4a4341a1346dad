"""What the operators of this subpackage share: hold-out rule, bounded samples, Arrow batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch; whole texts may be long, so a batch has to stay small (one text more than the bytes at most).
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small in rows and bytes, unless the session already asks for less."""
    for name, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        asked = spark.conf.get(key).rstrip("b")
        if not asked.isdigit() or not 0 < int(asked) <= most:
            spark.conf.set(key, most)


def drawn(key: str | Column, share: float | Column, seed: int) -> Column:
    """Whether the 63 bits of the key's seeded hash fall under ``share`` of their range.

    A share may be as small as a few of 1e18; from 1 on, every row is drawn.
    """
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 1)
    if isinstance(share, Column):
        return F.when(share >= 1, True).otherwise(h < F.floor(share * float(1 << 63)).cast("long"))
    return F.lit(True) if share >= 1 else h < F.lit(int(share * (1 << 63)))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def labelled_sample(labels: DataFrame, target: str, train: Column, bound: int, seed: int) -> tuple[DataFrame, float]:
    """(doc_id, y) of labelled documents of the training folds, and the log odds to add to what is learnt from them.

    y is 1 if any label of the id isn't 0. Of either class, the ids are drawn whose seeded
    hash falls under bound / (2 * its count), so about ``bound`` rows come out at most, which
    may be broadcast, and they don't depend on partitioning. As the classes are drawn
    apart, the odds of the sample differ from those of all labels; the second value is the
    logarithm of their ratio, from the rows that were really drawn.
    """
    rows = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & train)
    rows = rows.groupBy("doc_id").agg(F.max((F.col(target) != 0).cast("int")).alias("y"))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    share = {y: min(1.0, bound / 2 / max(1, n.get(y, 0))) for y in (0, 1)}
    chosen = rows.where(F.when(F.col("y") == 1, drawn("doc_id", share[1], seed)).otherwise(drawn("doc_id", share[0], seed)))
    if min(share.values()) >= 1:
        return chosen, 0.0
    got = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    real = {y: got[y] / n[y] if got.get(y) else share[y] for y in (0, 1)}
    return chosen, math.log(real[0] / real[1])
