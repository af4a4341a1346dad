"""Mixing sources to target weights: budgets filled exactly by subset sums over token lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.llm.common import fresh
from trendloom.plans.scratch import Scratch

WEIGHTS = (5, 2, 1)
#: Words of the mix over words of the input; times a source may be used at most.
SHARE, CAP = 1.5, 2.0
#: Bits of the reachable sums that one dynamic programme keeps; rows of a plan that may be broadcast, some 60 bytes each.
BITS, PLAN_ROWS = 1 << 28, 1_000_000


def size_of(text: str = "text") -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Words to take of each source.

    Sources in order of code point, null last, weigh 5, 2, 1, repeating. They split ``share``
    of all words by weight; what is above ``cap`` times a source is split again among the rest.
    """
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    open_, left = list(names), share * sum(sizes.values())
    while open_:
        by = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * by > cap * sizes[s]]
        if not full:
            out |= {s: weight[s] * by for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def subset_sum(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length, at most its count, for the largest sum within the budget.

    Bounded knapsack over bit sets: bit s of a set says that sum s can be reached with the
    lengths so far. Counts are split into powers of two; the stored sets lead back.
    """
    reach, items, sets = 1, [], []
    mask = (1 << (budget + 1)) - 1
    for i, (size, n) in enumerate(zip(lengths, counts, strict=True)):
        n, power = min(n, budget // size) if size > 0 else 0, 1
        while n > 0:
            k = min(power, n)
            items.append((i, k))
            sets.append(reach)
            reach |= (reach << (k * size)) & mask
            n, power = n - k, power * 2
        if reach >> budget & 1:
            break
    at, take = reach.bit_length() - 1, [0] * len(lengths)
    for (i, k), before in zip(reversed(items), reversed(sets), strict=True):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def _steps(count: int) -> int:
    """Powers of two, and a rest, that subset_sum() splits a count into."""
    return int(count).bit_length()


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length fill the budget.

    A bounded knapsack finds the largest sum within it. Where its bit sets would take more than
    BITS, each length first gives its share, rounded down, and only the rest is left to the
    knapsack; if that is still too much, sums are counted in units, lengths rounded up, and
    what the rounding leaves goes to another pass, in smaller units, until nothing is gained.
    So the sum found is the best where BITS allow, and else short by less than one document.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    budget = max(0, min(int(budget), total))
    take = np.zeros(len(lengths), dtype=np.int64)
    if not total or not budget:
        return take
    steps = sum(_steps(c) for c, n in zip(counts, lengths, strict=True) if 0 < n <= budget)
    if steps * budget > BITS:
        take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
        take[lengths == 0] = 0
    mixed_up = sorted(range(len(lengths)), key=lambda i: xxhash.xxh64_intdigest(str(int(lengths[i])), 5))  # else short ones would come first
    while left := budget - int((take * lengths).sum()):
        open_ = [i for i in mixed_up if 0 < lengths[i] <= left and take[i] < counts[i]]
        unit = -(-sum(_steps(counts[i] - take[i]) for i in open_) * left // BITS) or 1
        extra = subset_sum([-(-int(lengths[i]) // unit) for i in open_], [int(counts[i] - take[i]) for i in open_], left // unit) if open_ else []
        if not open_ or (unit == 1 and not any(extra)):
            break
        if any(extra):
            take[open_] += np.array(extra, dtype=np.int64)
        else:  # what fits, just not in units
            take[max(open_, key=lambda i: lengths[i])] += 1
    return take


def aims(sizes: DataFrame, scratch: Scratch, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(k, s, t): of each source (k, s) the words to take, as targets() gives them.

    There may be as many sources as web domains, so none reach the driver: they are numbered by
    a sort of ranges, and the level up to which the mix fills them is found by aggregates, one
    for each step in which further sources turn out to be full. Keys sort as sources do, "n",
    the null source, last.
    """
    order = [F.col("k") == "n", F.col("k")]
    placed = scratch.save(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("i", F.monotonically_increasing_id()), "sources")
    before, parts = 0, []
    for r in placed.groupBy(F.shiftrightunsigned("i", 33).alias("p")).count().orderBy("p").collect():  # a row for each partition
        parts += [F.lit(r["p"]), F.lit(before)]
        before += r["count"]
    if not parts:
        return placed.select("k", "s", F.lit(0.0).alias("t"))
    rank = F.create_map(*parts)[F.shiftrightunsigned("i", 33)] + F.col("i").bitwiseAND((1 << 33) - 1)
    placed = placed.select("k", "s", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS)).cast("int") + 1).alias("w"))
    level, full = 0.0, F.lit(False)
    known = -1
    while True:
        got = placed.agg(F.sum("s").alias("all"), F.sum(F.when(full, F.col("s"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("w"), F.count(F.when(full, 1)).alias("n")).first()
        if not got["w"] or got["n"] == known:
            break
        known, level = got["n"], (share * got["all"] - cap * (got["full"] or 0)) / got["w"]
        full = F.col("w") * level > cap * F.col("s")
    return placed.select("k", "s", F.when(full, cap * F.col("s")).otherwise(F.col("w") * level).cast("double").alias("t"))


def plan(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, l, whole, cut, ties, take, s, t) of a table (k, l, h) of documents' sources, sizes and hashes.

    A document is taken ``whole`` times, and once more if its hash is below ``cut``; of the
    ``ties`` documents whose hash is just that, ``take`` are. Documents are counted by source,
    size and bucket of the hash; the counts of a source by size fill its budget; only hashes of
    the buckets where a count ends are looked at, summed up with map-side partials, so that no
    task ranks a whole size, however common it is, nor the copies of one document. A task that
    fills a budget holds the distinct sizes of one source.
    """
    bucket = F.shiftright("h", 53).cast("int")
    counts = scratch.save(rows.groupBy("k", "l", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")), "counts")
    aim = aims(counts.groupBy("k").agg(F.sum(F.col("l") * F.col("n")).alias("s")), scratch)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("l")
        s, t = int(pdf["s"].iloc[0]), float(pdf["t"].iloc[0])
        whole = int(t // s) if s else 0
        take = fit_budget(pdf["l"].to_numpy(), pdf["n"].to_numpy(), round(t - whole * s)) if s else np.zeros(len(pdf), dtype=np.int64)
        return pd.DataFrame({"k": pdf["k"], "l": pdf["l"], "whole": whole, "more": take, "s": s, "t": t})

    by_size = counts.groupBy("k", "l").agg(F.sum("n").alias("n")).join(aim, "k")
    fitted = scratch.save(by_size.groupBy("k").applyInPandas(fit, "k string, l long, whole int, more long, s long, t double"), "fitted")

    def upto(at: str, *by: str):
        return F.sum("n").over(Window.partitionBy(*by).orderBy(at))

    ends = counts.withColumn("upto", upto("b", "k", "l")).join(fitted.where("more > 0").select("k", "l", "more"), ["k", "l"])
    ends = scratch.save(ends.where("upto - n < more and more <= upto").select("k", "l", "b", (F.col("more") - F.col("upto") + F.col("n")).alias("more")), "ends")
    hashes = rows.withColumn("b", bucket).join(ends, ["k", "l", "b"]).groupBy("k", "l", "b", "more", "h").agg(F.count(F.lit(1)).alias("n"))
    cuts = hashes.withColumn("upto", upto("h", "k", "l", "b")).where("upto - n < more and more <= upto")
    cuts = cuts.select("k", "l", F.col("h").alias("cut"), F.col("n").alias("ties"), (F.col("more") - F.col("upto") + F.col("n")).alias("take"))
    return scratch.save(fitted.drop("more").join(cuts, ["k", "l"], "left"), "plan")


def keyed(docs: DataFrame, seed: int = 11) -> tuple[DataFrame, list[str]]:
    """docs with the columns of plan()'s rows, and their names: the source as key, the size, a hash of id and text of 63 bits."""
    k, l, h = names = [fresh(docs, f"mix_{c}") for c in ("key", "size", "hash")]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return docs.withColumns({k: key, l: size_of(), h: F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 1)}), names


def with_copies(rows: DataFrame, names: list[str], planned: DataFrame) -> tuple[DataFrame, list[str]]:
    """rows with three columns more: copies to take, the source's size, its target.

    The plan has a row for each source and size; up to PLAN_ROWS of them, by count, are
    broadcast, so that rows, which may hold texts, needn't be shuffled. Rows of equal hash that
    are not all taken are the only ones that are ranked.
    """
    k, l, h = names
    small = planned.count() <= PLAN_ROWS
    add = {c: fresh(rows, f"mix_{c}") for c in ("whole", "cut", "ties", "take", "s", "t", "copies", "rank")}
    table = planned.select(F.col("k").alias(k), F.col("l").alias(l), *[F.col(c).alias(add[c]) for c in ("whole", "cut", "ties", "take", "s", "t")])
    out = rows.join(F.broadcast(table) if small else table, [k, l])
    tied = (F.col(h) == F.col(add["cut"])) & (F.col(add["take"]) < F.col(add["ties"]))
    more = F.coalesce(F.col(h) <= F.col(add["cut"]), F.lit(False)).cast("int")
    copies = lambda more: F.when(F.col(l) > 0, F.col(add["whole"]) + more).otherwise(0)
    if planned.where("take < ties").isEmpty():
        out = out.withColumn(add["copies"], copies(more))
    else:
        tied = F.coalesce(tied, F.lit(False))
        rank = F.row_number().over(Window.partitionBy(k, l, h).orderBy("doc_id"))
        some = out.where(tied).withColumn(add["rank"], rank)
        some = some.withColumn(add["copies"], copies((F.col(add["rank"]) <= F.col(add["take"])).cast("int"))).drop(add["rank"])
        out = out.where(~tied).withColumn(add["copies"], copies(more)).unionByName(some)
    return out, [add["copies"], add["s"], add["t"]]


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs; taken counts the words of each copy.

    Null texts have size 0 and are taken 0 times; a null source is a source, the last in
    order; long texts count whole. Which documents of a size are taken once more follows from
    a seeded hash of id and text; of rows that repeat both, which one is immaterial. Other
    columns are ignored whatever their names; an empty table gives an empty one. Reruns agree,
    as everything follows from ids, texts and sources.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows, (k, l, h) = keyed(docs.select("doc_id", "source", "text"))
    slim = scratch.save(rows.select("doc_id", F.col(k).alias("k"), F.col(l).alias("l"), F.col(h).alias("h")), "slim")
    out, (copies, source_size, target) = with_copies(slim, ["k", "l", "h"], plan(slim.select("k", "l", "h"), scratch))
    return out.select("doc_id", F.col("l").alias("size"), F.col(source_size).alias("source_size"), F.col(target).alias("target"), (F.col("l") * F.col(copies)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it.

    Null and empty texts are never taken; long ones count whole; ties, repeated rows and null
    sources as in mix(). Texts are read twice, for their sizes and to be returned, but not
    shuffled. Columns keep their names and values; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows, names = keyed(docs)
    slim = scratch.save(rows.select(*[F.col(c).alias(n) for c, n in zip(names, "klh", strict=True)]), "slim")
    out, (copies, _, _) = with_copies(rows, names, plan(slim, scratch))
    once = fresh(out, "copy")
    return out.withColumn(once, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)
