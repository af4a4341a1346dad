"""Evaluation: agreement of runs, entropy and Gini of topics, coverage, summaries, report."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.vectors import EPS
from trendloom.operators.centroids import certainty, silhouette
from trendloom.operators.keywords import coherence, diversity
from trendloom.plans.scratch import Scratch


def contingency(a: DataFrame, b: DataFrame, both_assigned: bool = False) -> DataFrame:
    """(a, b, n) of two tables (doc_id, topic) over the documents in both."""
    joined = a.select("doc_id", F.col("topic").alias("a")).join(b.select("doc_id", F.col("topic").alias("b")), "doc_id")
    if both_assigned:
        joined = joined.where("a <> -1 and b <> -1")
    return joined.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def ami(cells: list[tuple[int, int, int]]) -> float:
    """Q13: adjusted mutual information of a contingency table, arithmetic normaliser."""
    n = sum(c[2] for c in cells)
    rows, cols = Counter(), Counter()
    for i, j, k in cells:
        rows[i] += k
        cols[j] += k
    mi = sum(k / n * math.log(n * k / (rows[i] * cols[j])) for i, j, k in cells if k)
    return _adjusted(mi, Counter(rows.values()), Counter(cols.values()), n)


def _adjusted(mi: float, a: dict[int, int], b: dict[int, int], n: int) -> float:
    """AMI from the mutual information and how many groups of each size either side has."""
    rows, cols = sum(a.values()), sum(b.values())
    if not n or rows == cols == 1 or rows == cols == n:
        return 1.0
    h = lambda m: -sum(c * k / n * math.log(k / n) for k, c in m.items() if k)
    emi = sum(x * y * _mean_mi(i, j, n) for i, x in a.items() for j, y in b.items())
    spread = (h(a) + h(b)) / 2 - emi
    least = 2.220446049250313e-16
    return (mi - emi) / (min(spread, -least) if spread < 0 else max(spread, least))


def _mean_mi(i: int, j: int, n: int) -> float:
    """What groups of i and j of n documents give to the mean mutual information of random tables.

    Their overlap k is hypergeometric. Only overlaps within 10 deviations and 40 of the mean are
    summed, beyond which less than 1e-20 of the mass lies; probabilities follow from their
    ratios, so a pair costs a vector as long as that range.
    """
    mean = i * j / n
    reach = 10 * math.sqrt(mean * (1 - i / n) * (n - j) / max(1, n - 1)) + 40
    low, high = max(1, i + j - n, math.floor(mean - reach)), min(i, j, math.ceil(mean + reach))
    if low > high:
        return 0.0
    k = np.arange(low, high + 1, dtype=float)
    g, mode = math.lgamma, int(min(max(round(mean), low), high))
    at_mode = g(i + 1) + g(j + 1) + g(n - i + 1) + g(n - j + 1) - g(n + 1) - g(mode + 1) - g(i - mode + 1) - g(j - mode + 1) - g(n - i - j + mode + 1)
    steps = np.log((i - k[:-1]) * (j - k[:-1]) / ((k[:-1] + 1) * (n - i - j + k[:-1] + 1)))
    logs = np.append(0.0, np.cumsum(steps))
    return float((k / n * np.log(n * k / (i * j)) * np.exp(logs - logs[mode - low] + at_mode)).sum())


def expected_mi(a: list[int], b: list[int], n: int) -> float:
    """Mean mutual information of random tables with the given margins (hypergeometric)."""
    return sum(x * y * _mean_mi(i, j, n) for i, x in Counter(a).items() for j, y in Counter(b).items())


def _table_ami(cells: DataFrame) -> tuple[int, float]:
    """(documents, AMI) of a contingency table (a, b, n); only how many groups have which size reaches the driver."""
    total = cells.agg(F.sum("n")).first()[0] or 0
    if not total:
        return 0, 1.0
    a, b = (cells.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in "ab")
    part = F.col("n") / F.lit(total) * F.ln(F.lit(float(total)) * F.col("n") / (F.col("na") * F.col("nb")))
    mi = cells.join(a, "a").join(b, "b").agg(F.sum(part)).first()[0]
    sizes = ({r[0]: r[1] for r in g.groupBy(f"n{c}").count().collect()} for g, c in ((a, "a"), (b, "b")))
    return total, _adjusted(mi, *sizes, total)


def agreement(runs: dict[str, DataFrame], least: int = 5) -> DataFrame:
    """Q13: (left, right, docs, ami_all, docs_both, ami_both) for each two runs (doc_id, topic); none under ``least`` documents."""
    names = sorted(runs)
    spark = next(iter(runs.values())).sparkSession
    scratch = Scratch(spark, "agreement")
    rows = []
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            cells = scratch.save(contingency(runs[x], runs[y]), "cells")
            (n, all_), (m, both) = _table_ami(cells), _table_ami(cells.where("a <> -1 and b <> -1"))
            rows.append((x, y, n, all_ if n >= least else None, m, both if m >= least else None))
    return spark.createDataFrame(rows, "left string, right string, docs long, ami_all double, docs_both long, ami_both double")


def topic_entropy(docs: DataFrame) -> DataFrame:
    """(topics, entropy, entropy_norm) of the sizes of topics, outliers aside."""
    sizes = docs.where("topic <> -1").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    all_ = sizes.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    out = sizes.join(F.broadcast(all_), F.lit(True)).agg(F.count(F.lit(1)).alias("topics"), F.sum(-p * F.ln(p + EPS)).alias("entropy"))
    return out.withColumn("entropy_norm", F.when(F.col("topics") > 1, F.col("entropy") / F.ln(F.when(F.col("topics") > 1, F.col("topics")).otherwise(2).cast("double"))).otherwise(0.0))


def gini(docs: DataFrame) -> DataFrame:
    """Gini coefficient of the sizes of topics.

    Ranks are of distinct sizes, of which n documents have at most the root of 2n, so the one
    ordered window stays small however many topics there are.
    """
    sizes = docs.where("topic <> -1").groupBy("topic").agg(F.count(F.lit(1)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2  # of the m topics of size x, summed up
    sums = sizes.select("x", "m", ranks.alias("r")).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("x")).alias("s"), F.sum(F.col("r") * F.col("x")).alias("rx"))
    return sums.select(((2 * F.col("rx") / F.col("s") - F.col("n") - 1) / F.col("n")).alias("gini"))


def coverage(docs: DataFrame) -> DataFrame:
    """Documents, topics, outliers and coverage."""
    return docs.agg(
        F.count(F.lit(1)).alias("docs"), F.countDistinct(F.when(F.col("topic") != -1, F.col("topic"))).alias("topics"),
        F.count_if(F.col("topic") == -1).alias("outliers"), (1 - F.count_if(F.col("topic") == -1) / F.count(F.lit(1))).alias("coverage"),
    )


def by_source(docs: DataFrame, value: str = "assignment_confidence", source: str = "assignment_source") -> DataFrame:
    """N, mean, median and percentiles of a value by source."""
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.25), F.lit(0.75), F.lit(0.9)))
    out = docs.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), p.alias("p"))
    return out.select(source, "n", "mean", "median", *[F.get("p", F.lit(i)).alias(k) for i, k in enumerate(("p10", "p25", "p75", "p90"))])


METRICS = [
    "docs", "topics", "coverage", "outliers", "diversity", "coherence_cv", "coherence_npmi", "silhouette", "certainty", "entropy", "entropy_norm",
    "emerging_topics_count", "avg_semantic_drift", "wall_clock_seconds", "llm_calls",
]


def evaluate_run(docs: DataFrame, texts: DataFrame, keywords: DataFrame, trends: DataFrame | None = None, shift: DataFrame | None = None, run: dict | None = None, window: int = 20, min_df: int = 2) -> DataFrame:
    """Q19: (metric, value), the 15 METRICS of a run, null where it has nothing to measure.

    From documents (doc_id, topic[, embedding]), texts (doc_id, text), keywords (topic, term),
    trends with a column mk_trend or mk_trend_rel, shifts with drift_robust_score, and the run's
    own figures. A rising trend counts as emerging whatever its q-value.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "evaluate")
    docs = scratch.save(docs, "docs")
    counts, spread = coverage(docs), topic_entropy(docs)
    one = [(c, counts, c) for c in ("docs", "topics", "coverage", "outliers")] + [(c, spread, c) for c in ("entropy", "entropy_norm")]
    one.append(("diversity", diversity(keywords), "diversity"))
    agreed = scratch.save(coherence(texts, keywords, window, min_df).agg(F.avg("c_v").alias("coherence_cv"), F.avg("c_npmi").alias("coherence_npmi")), "coherence")
    one += [("coherence_cv", agreed, "coherence_cv"), ("coherence_npmi", agreed, "coherence_npmi")]
    if "embedding" in docs.columns:
        one += [("silhouette", silhouette(docs), "silhouette"), ("certainty", certainty(docs), "certainty")]
    if trends is not None:
        name = "mk_trend" if "mk_trend" in trends.columns else "mk_trend_rel"
        one.append(("emerging_topics_count", trends.agg(F.count_if(F.col(name) == "increasing").alias("n")), "n"))
    if shift is not None:
        one.append(("avg_semantic_drift", shift.agg(F.avg("drift_robust_score").alias("d")), "d"))
    given = [(k, float(run[k])) for k in ("wall_clock_seconds", "llm_calls") if run and run.get(k) is not None]
    out = reduce(DataFrame.union, [df.select(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, df, c in one])
    out = out.union(spark.createDataFrame(given, "metric string, value double"))
    names = spark.createDataFrame([(i, m) for i, m in enumerate(METRICS)], "i int, metric string")
    return names.join(out, "metric", "left").orderBy("i").select("metric", "value")


def compare(runs: DataFrame) -> DataFrame:
    """Q20, A5: (label, metric, n_runs, mean, std) of (label, run, metric, value); one run has deviation 0."""
    return runs.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("label", "metric").agg(F.countDistinct("run").alias("n_runs"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def compare_agreement(runs: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Q20: (label, metric, n_runs, mean, std) of the AMI between each two runs (doc_id, topic) of a label: of all documents, of those assigned in both, and the smallest overlap."""
    parts = []
    for label, tables in sorted(runs.items()):
        if len(tables) < 2:
            continue
        pairs = agreement(tables)
        n = F.lit(len(tables)).cast("long").alias("n_runs")
        for metric, column in (("ami_all", "ami_all"), ("ami_assigned", "ami_both")):
            parts.append(pairs.agg(F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("std")).select(F.lit(label).alias("label"), F.lit(metric).alias("metric"), n, "mean", "std"))
        parts.append(pairs.agg(F.min("docs").cast("double").alias("mean")).select(F.lit(label).alias("label"), F.lit("ami_doc_overlap_min").alias("metric"), n, "mean", F.lit(0.0).alias("std")))
    return reduce(DataFrame.union, parts).where("mean is not null")


def stratified(docs: DataFrame, per_topic: int = 200, most: int = 2000, seed: int = 42) -> DataFrame:
    """Up to ``per_topic`` documents of each topic by seeded hash (MD5 of id and seed), then ``most`` of all."""
    h = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f":{seed}")))
    w = Window.partitionBy("topic").orderBy(h, "doc_id")
    return docs.where("topic <> -1").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_topic).drop("_r").orderBy(h, "doc_id").limit(most)


def render(title: str, *tables: tuple[str, DataFrame]) -> str:
    """K6, K8: a Markdown report of small tables."""
    out = [f"# {title}"]
    for name, df in tables:
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.collect()]
    return "\n".join(out) + "\n"
