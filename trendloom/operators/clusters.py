"""Density clustering of vectors, and what is built on it: topic model, augmentation, splitting, stability."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.functions.vectors import dot, unit
from trendloom.operators.centroids import centroids, topic_spread
from trendloom.operators.concepts import purity, symbolic_topics
from trendloom.operators.evaluate import agreement
from trendloom.operators.keywords import ctfidf
from trendloom.plans.scratch import Scratch


class Clusterer(Protocol):
    """Labels of rows, -1 for noise, and strengths in [0, 1]; has to be picklable."""

    def labels(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...


class DensityClusters:
    """Hierarchical density clusters: mutual reachability, spanning tree, condensed tree, eom or leaf selection.

    Quadratic in the rows of one call, which ``fit_topics`` bounds by its sample.
    """

    def __init__(self, min_cluster_size: int = 50, min_samples: int = 10, method: str = "eom"):
        self.size, self.samples, self.method = min_cluster_size, min_samples, method

    def tree(self, x: np.ndarray) -> list[tuple[float, int, int]]:
        """Edges of a minimum spanning tree by mutual reachability, in order of length."""
        n = len(x)
        sq = (x * x).sum(1)
        core = np.empty(n)
        for at in range(0, n, 512):
            d = np.maximum(sq[at : at + 512, None] + sq - 2 * x[at : at + 512] @ x.T, 0)
            core[at : at + 512] = np.sqrt(np.partition(d, min(self.samples, n - 1), axis=1)[:, min(self.samples, n - 1)])
        inside, best, source, at = np.zeros(n, dtype=bool), np.full(n, np.inf), np.zeros(n, dtype=int), 0
        edges = []
        for _ in range(n - 1):
            inside[at] = True
            d = np.sqrt(np.maximum(sq + sq[at] - 2 * x @ x[at], 0))
            d = np.maximum(np.maximum(d, core), core[at])
            nearer = ~inside & (d < best)
            best[nearer], source[nearer] = d[nearer], at
            best[inside] = np.inf
            at = int(np.argmin(best))
            edges.append((float(best[at]), int(source[at]), at))
        return sorted(edges)

    def labels(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        if n < max(2, self.size):
            return np.full(n, -1), np.zeros(n)
        # Merge tree: node n + k joins two nodes at a distance.
        kids, dist, size = {}, {}, [1] * n
        find = list(range(2 * n - 1))

        def root(i: int) -> int:
            while find[i] != i:
                find[i] = find[find[i]]
                i = find[i]
            return i

        for k, (d, a, b) in enumerate(self.tree(x)):
            a, b = root(a), root(b)
            node = n + k
            kids[node], dist[node] = (a, b), d
            find[a] = find[b] = node
            size.append(size[a] + size[b])
        # Condensed tree: a cluster lives from where it splits off to where it splits or fades.
        birth, stability, members, children, strength = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}, np.zeros(n)
        death: dict[int, float] = {}
        stack, next_id = [(2 * n - 2, 0)], 1

        def leaves(i: int) -> list[int]:
            out, todo = [], [i]
            while todo:
                j = todo.pop()
                if j < n:
                    out.append(j)
                else:
                    todo += kids[j]
            return out

        while stack:
            node, c = stack.pop()
            if node < n:
                members[c].append((node, birth[c]))
                continue
            lam = 1 / max(dist[node], 1e-12)
            a, b = kids[node]
            big = [i for i in (a, b) if size[i] >= self.size]
            if len(big) == 2:
                stability[c] += (lam - birth[c]) * size[node]
                death[c] = lam
                for i in big:
                    birth[next_id], stability[next_id], members[next_id], children[next_id] = lam, 0.0, [], []
                    children[c].append(next_id)
                    stack.append((i, next_id))
                    next_id += 1
                continue
            for i in (a, b):
                if i in big:
                    stack.append((i, c))
                else:
                    gone = leaves(i)
                    stability[c] += (lam - birth[c]) * len(gone)
                    members[c] += [(j, lam) for j in gone]
            if not big:
                death[c] = lam
        chosen, value = set(), dict(stability)
        for c in sorted(birth, reverse=True):
            if c == 0:
                continue
            below = sum(value[k] for k in children[c])
            if not children[c] or (self.method == "eom" and stability[c] >= below):
                todo = list(children[c])
                while todo:
                    k = todo.pop()
                    chosen.discard(k)
                    todo += children[k]
                chosen.add(c)
            else:
                value[c] = below
        out = np.full(n, -1)
        for label, c in enumerate(sorted(chosen)):
            todo, own = [c], []
            while todo:
                k = todo.pop()
                own += members[k]
                todo += children[k]
            longest = max((lam for _, lam in own), default=1.0) or 1.0
            for j, lam in own:
                out[j], strength[j] = label, min(1.0, lam / longest)
        return out, strength


def reduce_vectors(docs: DataFrame, k: int = 5) -> DataFrame:
    """Docs (doc_id, embedding) -> (doc_id, x): principal components of the unit vectors."""
    rows = docs.where(F.col("embedding").isNotNull()).select("doc_id", array_to_vector(unit("embedding")).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    return model.transform(rows).select("doc_id", vector_to_array("p").alias("x"))


#: Rows that are clustered in one task at most: the work of one is quadratic in them, its memory linear.
SAMPLE = 20_000


def _sampled(rows: DataFrame, clusterer: Clusterer, sample: int, seed: int, kind: str) -> DataFrame:
    """(doc_id, x, topic, probability) of about ``sample`` of rows (doc_id, x), topics in order of falling size, clustered in one task."""
    n = rows.count()
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 1)
    part = rows if n <= sample else rows.where(h < F.lit(int(sample / n * (1 << 63))))

    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        pdf = pd.concat(held).sort_values("doc_id")
        labels, strength = clusterer.labels(np.array(pdf["x"].tolist(), dtype=float))
        order = {c: i for i, (c, _) in enumerate(sorted(((c, (labels == c).sum()) for c in set(labels.tolist()) - {-1}), key=lambda t: (-t[1], t[0])))}
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "x": pdf["x"], "topic": [order.get(c, -1) for c in labels.tolist()], "probability": np.where(labels >= 0, strength, 0.0)})

    return part.select("doc_id", "x").repartition(1).mapInPandas(run, f"doc_id {kind}, x array<double>, topic int, probability double")


def _attached(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, topic, probability) of rows (doc_id, x) that lie no farther from a topic's centre than its farthest member in found, the nearest such.

    The topics of one sample are few (no more than its rows), so their centres and reaches are broadcast.
    """
    inside = found.where("topic <> -1")
    centres = inside.select("topic", F.posexplode("x").alias("i", "v")).groupBy("topic", "i").agg(F.avg("v").alias("v")).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("c"))
    away = F.sqrt(F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    table = inside.join(F.broadcast(centres), "topic").groupBy("topic", "c").agg(F.max(away).alias("reach")).orderBy("topic").collect()
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["topic"] for r in table]), np.array([r["c"] for r in table], dtype=float), np.array([r["reach"] for r in table])))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        topics, c, reach = shared.value
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float)
            for at in range(0, len(x), 1024):
                d = np.sqrt(((x[at : at + 1024, None] - c) ** 2).sum(2))
                d[d > reach] = np.inf
                best = d.argmin(1)
                near = d[np.arange(len(d)), best]
                ok = np.isfinite(near)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[at : at + 1024][ok], "topic": topics[best[ok]], "probability": 1 - near[ok] / (reach[best[ok]] + 1e-12)})

    return rows.mapInPandas(run, f"doc_id {kind}, topic int, probability double")


def fit_topics(docs: DataFrame, clusterer: Clusterer | None = None, components: int = 5, sample: int = SAMPLE, seed: int = 42, gain: float = 0.01) -> DataFrame:
    """M5: (doc_id, topic, probability) of docs (doc_id, embedding), topics in order of falling size, ties in order of discovery.

    Rounds of one rule: about ``sample`` of the rows without a topic, all if they are no more, by
    seeded hash, are clustered in one task; the other rows join the nearest of the topics found
    that reaches them. Rounds end when all rows left were in the sample, or it has no cluster, or
    its topics take less than ``gain`` of the rows left, as clusters of mere noise do. So up to ``sample`` rows are clustered as a whole; of more, dense topics are found first, and
    rarer ones among what they leave; a topic stays unfound if the sample of the last round
    holds fewer of its rows than the clusterer's least size. Rows without a vector get no row.
    """
    clusterer = clusterer or DensityClusters()
    scratch = Scratch(docs.sparkSession, "topics")
    left = scratch.save(reduce_vectors(docs, components), "reduced")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts, topics, turn = [], 0, 0
    while True:
        found = scratch.save(_sampled(left, clusterer, sample, seed + turn, kind), "sample")
        n = found.where("topic <> -1").select("topic").distinct().count()
        if not n:
            break
        rest = left.join(found.select("doc_id"), "doc_id", "left_anti")
        whole = rest.isEmpty()
        got = found.where("topic <> -1").select("doc_id", "topic", "probability")
        got = scratch.save(got if whole else got.union(_attached(rest, found)), "attached")
        parts.append(got.withColumn("topic", (F.col("topic") + F.lit(topics)).cast("int")))
        before = left.count()
        left = scratch.save(left.join(got.select("doc_id"), "doc_id", "left_anti"), "left")
        topics, turn = topics + n, turn + 1
        if whole or before - left.count() < gain * before:
            break
    out = left.select("doc_id", F.lit(-1).alias("topic"), F.lit(0.0).alias("probability"))
    if parts:
        all_ = reduce(DataFrame.union, parts)
        if turn > 1:  # sizes of different rounds
            sizes = sorted(((-r["count"], r["topic"]) for r in all_.groupBy("topic").count().collect()))
            ranks = docs.sparkSession.createDataFrame([(t, i) for i, (_, t) in enumerate(sizes)], "topic int, rank int")
            all_ = all_.join(F.broadcast(ranks), "topic").select("doc_id", F.col("rank").alias("topic"), "probability")
        out = out.union(all_)
    return out


def split_topics(docs: DataFrame, min_size: int = 200, mean_sim: float = 0.60, std_sim: float = 0.12, clusterer: Clusterer | None = None, duplicate: float = 0.90, sample: int = SAMPLE) -> DataFrame:
    """Docs with loose topics split: the largest part keeps the id, others get the next free ones.

    A part whose centroid is within ``duplicate`` of a topic other than the one it leaves stays there.

    A topic of ``min_size`` is left alone if its mean similarity is ``mean_sim`` or more and its
    deviation ``std_sim`` or less. Others are clustered in the vectors' first components, one
    task a topic, of a topic of more than ``sample`` documents about so many by hash; its other
    documents, and noise, stay with the topic, as do parts that the sample has too few rows of.
    """
    clusterer = clusterer or DensityClusters(6, 2, "leaf")
    loose = topic_spread(docs).where((F.col("n") >= min_size) & ~((F.col("mean_sim") >= mean_sim) & (F.col("std_sim") <= std_sim))).select("topic", "n")
    h = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 1)
    inside = (F.col("n") <= sample) | (h < F.floor(F.lit(float(sample)) / F.col("n") * float(1 << 63)).cast("long"))
    rows = docs.join(loose, "topic").where(inside).select("topic", "doc_id", unit("embedding").alias("v"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        x = np.array(pdf["v"].tolist(), dtype=float)
        x = x - x.mean(0)
        labels, _ = clusterer.labels(x @ np.linalg.svd(x, full_matrices=False)[2][:5].T)
        sizes = sorted(set(labels.tolist()) - {-1}, key=lambda c: (-(labels == c).sum(), c))
        part = {c: i for i, c in enumerate(sizes)} if len(sizes) >= 2 else {}
        return pd.DataFrame({"topic": pdf["topic"].to_numpy(), "doc_id": pdf["doc_id"].to_numpy(), "part": [part.get(c, 0) for c in labels.tolist()]})

    parts = rows.groupBy("topic").applyInPandas(run, f"topic int, doc_id {kind}, part int").where("part > 0")
    parts = Scratch(docs.sparkSession, "split").save(parts, "parts")
    last = docs.agg(F.max("topic")).first()[0] or 0
    keys = sorted((r["topic"], r["part"]) for r in parts.select("topic", "part").distinct().collect())
    ids = docs.sparkSession.createDataFrame([(t, p, last + 1 + i) for i, (t, p) in enumerate(keys)], "topic int, part int, new int")
    moved = parts.join(F.broadcast(ids), ["topic", "part"]).select("doc_id", F.col("topic").alias("_t"), "new")
    fresh = centroids(docs.join(moved.withColumnRenamed("_t", "topic"), ["doc_id", "topic"]), ["topic", "new"]).select("topic", "new", F.col("centroid").alias("c"))
    old = centroids(docs.where("topic <> -1"), ["topic"]).select(F.col("topic").alias("other"), "centroid")
    like = fresh.join(F.broadcast(old), F.col("other") != F.col("topic")).where(F.round(dot("c", "centroid"), 9) >= duplicate).select("new").distinct()
    moved = moved.join(F.broadcast(like), "new", "left_anti").select("doc_id", F.col("_t").alias("topic"), "new")
    out = docs.join(moved, ["doc_id", "topic"], "left")
    return out.withColumns({"parent_topic": F.when(F.col("new").isNotNull(), F.col("topic")), "topic": F.coalesce("new", "topic")}).drop("new")


def augment(docs: DataFrame, least: int = 8, min_samples: int = 3, top_weight: float = 0.0, pure: float = 0.0, label_sim: float = 0.65, sample: int = SAMPLE) -> DataFrame:
    """Docs (doc_id, topic, text, embedding, cso_top1_*) with new topics for outliers: by label first, then by density.

    A cluster counts if its best keyword weighs ``top_weight`` and its effective purity is
    ``pure`` or more. Assigned rows never change. Clusters are fit_topics()'s, by its sample.
    """
    scratch = Scratch(docs.sparkSession, "augment")
    named = scratch.save(symbolic_topics(docs, least, label_sim)[0], "symbolic")
    rest = named.where("topic = -1")
    if rest.count() <= max(10, least):
        return named
    found = scratch.save(fit_topics(rest, DensityClusters(least, min_samples, "leaf"), sample=sample), "clusters")
    trial = rest.drop("topic").join(found.where("topic <> -1").select("doc_id", "topic"), "doc_id")
    good = ctfidf(trial, 1).where(F.col("score") >= top_weight).select("topic").join(purity(trial).where(F.col("purity_eff") >= pure).select("topic"), "topic")
    last = named.agg(F.max("topic")).first()[0]
    new = found.join(F.broadcast(good), "topic").select("doc_id", (F.col("topic") + F.lit(last + 1)).alias("new"))
    return named.join(new, "doc_id", "left").withColumn("topic", F.when(F.col("topic") == -1, F.coalesce("new", "topic")).otherwise(F.col("topic"))).drop("new")


def stability(docs: DataFrame, runs: int = 3, seed: int = 42, clusterer: Clusterer | None = None, sample: int = SAMPLE) -> DataFrame:
    """Q12: (runs, mean_ami, std_ami) over pairs of clusterings with seeds 17 apart; (1, 0) for one run or none."""
    spark = docs.sparkSession
    if runs <= 1:
        return spark.createDataFrame([(runs, 1.0, 0.0)], "runs int, mean_ami double, std_ami double")
    scratch = Scratch(spark, "stability")
    tables = {f"{i:03d}": scratch.save(fit_topics(docs, clusterer, sample=sample, seed=seed + 17 * i), f"run{i}") for i in range(runs)}
    return agreement(tables).agg(F.lit(runs).alias("runs"), F.avg("ami_all").alias("mean_ami"), F.stddev_pop("ami_all").alias("std_ami"))
