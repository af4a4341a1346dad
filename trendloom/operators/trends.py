"""Trend statistics over many short series at once: a row for each series, its values in an array."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.vectors import two_sided
from trendloom.plans.scratch import Scratch


def series(rows: DataFrame, key: list[str], time: str, value: str, out: str = "xs") -> DataFrame:
    """One row for each key, with the values in order of time; a series is as long as there are periods."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("x"))))
    return rows.groupBy(*key).agg(pairs.alias(out)).withColumns({"ts": F.transform(out, lambda p: p["t"]), out: F.transform(out, lambda p: p["x"])})


def finite(xs: Column) -> Column:
    """The values that are neither null, NaN nor infinite."""
    return F.filter(xs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def kendall_s(xs: Column) -> Column:
    """Sum over pairs i < j of sign(x[j] - x[i])."""

    def later(x: Column, i: Column) -> Column:
        return F.aggregate(F.slice(xs, i + 2, F.size(xs)), F.lit(0.0), lambda s, y: s + F.signum(y - x))

    return F.aggregate(F.transform(xs, later), F.lit(0.0), lambda s, x: s + x)


def kendall_variance(xs: Column) -> Column:
    """(n(n-1)(2n+5) - sum over ties t(t-1)(2t+5)) / 18, values rounded to 10 places."""
    n = F.size(xs).cast("double")
    rounded = F.transform(xs, lambda x: F.round(x, 10))
    groups = F.transform(F.array_distinct(rounded), lambda v: F.size(F.filter(rounded, lambda x: x == v)).cast("double"))
    ties = F.aggregate(groups, F.lit(0.0), lambda s, t: s + t * (t - 1) * (2 * t + 5))
    return (n * (n - 1) * (2 * n + 5) - ties) / 18


def _verdict(p: Column, tau: Column, alpha: float) -> Column:
    return F.when((p <= alpha) & (tau > 0), "increasing").when((p <= alpha) & (tau < 0), "decreasing").otherwise("no_trend")


def mann_kendall(df: DataFrame, xs: str = "xs", alpha: float = 0.05, method: str = "classic", lag_max: int | None = None) -> DataFrame:
    """Q1 to Q3: adds mk_p, mk_tau and mk_trend of the series in column xs.

    ``classic``; ``tfpw`` takes the slope out, prewhitens by the lag-1 correlation of what is
    left, and puts it back; ``hamed_rao`` scales the variance by the correlations of ranks up
    to ``lag_max``, min(10, n - 1) if not given. Under three finite values, or without
    variance: p 1, tau 0, no trend.
    """
    if method not in ("classic", "tfpw", "hamed_rao"):
        raise ValueError(f"unknown method {method}")
    x = finite(F.col(xs))
    df = df.withColumn("_x", _prewhitened(x) if method == "tfpw" else x)
    scale = _inflation(lag_max)(F.col("_x")) if method == "hamed_rao" else F.lit(1.0)
    df = df.withColumns({"_s": kendall_s(F.col("_x")), "_v": kendall_variance(F.col("_x")) * scale, "_n": F.size("_x").cast("double")})
    flat = (F.col("_n") < 3) | (F.col("_v") <= 0)
    safe = F.sqrt(F.when(flat, 1.0).otherwise(F.col("_v")))
    z = (F.col("_s") - F.signum("_s")) / safe
    tau = F.when(flat, 0.0).otherwise(F.col("_s") / F.when(flat, 1.0).otherwise(F.col("_n") * (F.col("_n") - 1) / 2))
    df = df.withColumns({"mk_p": F.when(flat, 1.0).otherwise(two_sided(z)), "mk_tau": tau})
    return df.withColumn("mk_trend", _verdict(F.col("mk_p"), F.col("mk_tau"), alpha)).drop("_x", "_s", "_v", "_n")


def _slope(xs: np.ndarray) -> float:
    i, j = np.triu_indices(len(xs), 1)
    return float(np.median((xs[j] - xs[i]) / (j - i))) if len(i) else 0.0


def _pearson(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    d = math.sqrt(float((a * a).sum() * (b * b).sum()))
    return float((a * b).sum()) / d if d > 0 else 0.0


def prewhiten(xs: np.ndarray) -> np.ndarray:
    """Trend-free prewhitening of one series; the first point stays."""
    n = len(xs)
    if n < 3:
        return xs
    trend = _slope(xs) * np.arange(n)
    left = xs - trend
    r = max(-0.99, min(0.99, _pearson(left[:-1], left[1:])))
    out = left.copy()
    out[1:] = left[1:] - r * left[:-1]
    return out + trend


def inflation(xs: np.ndarray, lag_max: int | None = None) -> float:
    """Factor of the variance by the correlations of average ranks, 0.1 at least."""
    n = len(xs)
    if n < 3:
        return 1.0
    order = np.unique(xs, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(order[2]) - (order[2] - 1) / 2)[order[1]]
    total = 0.0
    for k in range(1, min(lag_max or 10, n - 1) + 1):
        if n - k < 3:
            break
        total += (1 - k / n) * _pearson(ranks[:-k], ranks[k:])
    return max(0.1, 1 + 2 * total)


def _prewhitened(x: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: prewhiten(np.array(v, dtype=float)))

    return run(x)


def _inflation(lag_max: int | None):
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: inflation(np.array(v, dtype=float), lag_max))

    return run


def theil_sen(ys: Column, ts: Column | None = None) -> Column:
    """Q5: median of the slopes between all pairs, those without distance left out; 0 without any."""
    at = F.sequence(F.lit(0), F.size(ys) - 1) if ts is None else ts
    pts = F.filter(F.arrays_zip(at.alias("t"), ys.alias("y")), lambda p: p["y"].isNotNull() & ~F.isnan(p["y"]))
    slopes = F.flatten(F.transform(pts, lambda p, i: F.transform(F.filter(F.slice(pts, i + 2, F.size(pts)), lambda q: q["t"] != p["t"]), lambda q: (q["y"] - p["y"]) / (q["t"] - p["t"]).cast("double"))))
    s = F.sort_array(slopes)
    n = F.size(s)
    mid = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when((F.size(ys) < 2) | (n <= 0), 0.0).otherwise(mid)


#: Bins of p-values for each halving of p, by which a family is dealt out.
P_BINS = 256


def bh_fdr(df: DataFrame, p: str, out: str, by: list[str] = ()) -> DataFrame:
    """Q7: Benjamini-Hochberg q-values of the finite p within each group of ``by``; other rows get null.

    Equal p have equal q, so distinct p are counted, binned by logarithm and ranked within their
    bin, after all that lower bins hold; q is the least p m / rank of the bin from there on and
    of higher bins. So no task has to hold a whole family, unless its p fall into few bins. df
    and the counts are written, as they are read more than once.
    """
    scratch = Scratch(df.sparkSession, "bh")
    held = scratch.save(df, "tests")
    family = F.struct(F.lit(0).alias("all"), *by)  # equal to itself where a field is null
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    bin_ = F.coalesce(F.floor(F.log2(F.col("_p").cast("double")) * P_BINS), F.lit(-(1 << 40)))  # the lowest if p is 0 or less
    cells = held.where(ok).groupBy(family.alias("_k"), F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    cells = scratch.save(cells.withColumn("_b", bin_), "counts")
    bins = cells.groupBy("_k", "_b").agg(F.sum("_n").alias("_all"))
    before = F.sum("_all").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_all")
    bins = bins.select("_k", "_b", before.alias("_before"), F.sum("_all").over(Window.partitionBy("_k")).alias("_m"))
    inside = Window.partitionBy("_k", "_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.join(bins, ["_k", "_b"]).withColumn("_r", F.col("_before") + F.sum("_n").over(inside.orderBy("_p")))
    ranked = scratch.save(ranked.select("_k", "_b", "_p", (F.col("_p") * F.col("_m") / F.col("_r")).alias("_v")), "ranked")
    least = ranked.groupBy("_k", "_b").agg(F.min("_v").alias("_low"))
    later = F.min("_low").over(Window.partitionBy("_k").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1))
    least = least.select("_k", "_b", later.alias("_later"))
    q = F.least(F.greatest(F.least(F.min("_v").over(inside.orderBy(F.desc("_p"))), F.col("_later")), F.lit(0.0)), F.lit(1.0))
    found = ranked.join(least, ["_k", "_b"]).select("_k", "_p", q.alias("_q"))
    return held.join(found, (family == F.col("_k")) & (F.col(p) == F.col("_p")), "left").select(*[F.col(f"`{c}`") for c in df.columns], F.col("_q").alias(out))


def bursts(xs: Column, base: float = 2.0, gamma: float = 1.0) -> Column:
    """Q6: struct(starts array<int>, max_level int, states array<int>) of a series of counts.

    Two passes of a fold with an array state: costs forward, with for each time the best level
    before each level, then back from the cheapest end. A level's rate is base**level times
    the mean; a change of level costs gamma times its size; ties go to the lowest level.
    """
    x = F.transform(xs, lambda v: v.cast("double"))
    n = F.size(x)
    mean = F.greatest(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.greatest(n, F.lit(1)), F.lit(1e-6))
    top = F.greatest(F.array_max(x), mean)
    count = F.greatest(F.lit(0), F.ceil(F.round(F.ln(top / mean) / math.log(base), 12))).cast("int") + 1
    ids = F.sequence(F.lit(0), count)
    cost = lambda v, j: mean * F.pow(F.lit(base), j) - v * F.ln(mean * F.pow(F.lit(base), j))
    argmin = lambda a: (F.array_position(a, F.array_min(a)) - 1).cast("int")
    start = F.struct(F.transform(ids, lambda j: gamma * j + cost(F.get(x, F.lit(0)), j)).alias("c"), F.array().cast("array<array<int>>").alias("back"))

    def forward(s: Column, v: Column) -> Column:
        step = lambda j: F.transform(ids, lambda i: F.get(s["c"], i) + gamma * F.abs(i - j))
        return F.struct(F.transform(ids, lambda j: F.array_min(step(j)) + cost(v, j)).alias("c"), F.concat(s["back"], F.array(F.transform(ids, lambda j: argmin(step(j))))).alias("back"))

    done = F.aggregate(F.slice(x, 2, F.greatest(n - 1, F.lit(1))), start, forward)
    end = argmin(done["c"])
    path = F.aggregate(F.reverse(done["back"]), F.array(end), lambda s, b: F.concat(F.array(F.get(b, F.get(s, F.lit(0)))), s))
    zero = (n <= 0) | (F.coalesce(F.array_max(x), F.lit(0.0)) <= 0)
    states = F.when(zero, F.transform(x, lambda _: F.lit(0))).otherwise(path)
    begins = F.filter(F.transform(states, lambda s, i: F.when((i > 0) & (s > F.get(states, i - 1)), i).otherwise(-1)), lambda i: i >= 0)
    return F.struct(begins.alias("starts"), F.coalesce(F.array_max(states), F.lit(0)).alias("max_level"), states.alias("states"))


def year_spine(docs: DataFrame, year: str = "year") -> DataFrame:
    """Every year from the first to the last."""
    ends = docs.agg(F.min(year).alias("a"), F.max(year).alias("b"))
    return ends.where("a is not null").select(F.explode(F.sequence("a", "b")).alias(year))


def prevalence(docs: DataFrame, key: str = "topic", outlier: int | None = -1, min_year_docs: int = 10, min_size: int = 1) -> DataFrame:
    """(key, year, n, year_total, share): a row for each key and usable year, zero counts included.

    W7: shares are of all documents of a year, outliers included; years run from the first to
    the last over all documents, and those with fewer than ``min_year_docs`` don't count.
    """
    docs = docs.select(key, "year")
    totals = docs.groupBy("year").agg(F.count(F.lit(1)).alias("year_total"))
    years = year_spine(docs).join(totals, "year", "left").select("year", F.coalesce("year_total", F.lit(0)).alias("year_total")).where(F.col("year_total") >= min_year_docs)
    own = docs.where(F.col(key) != outlier) if outlier is not None else docs
    counts = own.groupBy(key, "year").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy(key).agg(F.sum("n").alias("size")).where(F.col("size") >= min_size).select(key, "size")
    # The grid has a row for each topic and year, whatever the number of documents.
    axis = years.agg(F.collect_list(F.struct("year", "year_total")).alias("axis"))
    grid = keys.join(axis, F.lit(True)).select(key, "size", F.inline("axis"))
    return grid.join(counts, [key, "year"], "left").select(key, "size", "year", F.coalesce("n", F.lit(0)).alias("n"), "year_total", (F.coalesce("n", F.lit(0)) / F.col("year_total")).alias("share"))


def topic_trends(docs: DataFrame, alpha: float = 0.05, min_size: int = 15, min_year_docs: int = 10, method: str = "classic", lag_max: int | None = None, mode: str = "relative") -> DataFrame:
    """Q8: a row for each topic of ``min_size`` documents: trend tests and slopes of shares and counts, bursts, q-values, emerging.

    Fewer than three usable years give an empty table.
    """
    long = prevalence(docs, min_year_docs=min_year_docs, min_size=min_size)
    pairs = F.sort_array(F.collect_list(F.struct("year", "n", "share")))
    df = long.groupBy("topic", F.col("size").alias("topic_total_docs")).agg(pairs.alias("s")).where(F.size("s") >= 3)
    df = df.withColumns({"years": F.transform("s", lambda p: p["year"]), "rel": F.transform("s", lambda p: p["share"]), "abs": F.transform("s", lambda p: p["n"].cast("double"))})
    for name in ("rel", "abs"):
        df = mann_kendall(df, name, alpha, method, lag_max)
        df = df.withColumnsRenamed({c: f"{c}_{name}" for c in ("mk_p", "mk_tau", "mk_trend")}).withColumn(f"sen_slope_{name}", theil_sen(F.col(name)))
        df = bh_fdr(df, f"mk_p_{name}", f"mk_q_{name}")
    b = bursts(F.col("abs"))
    chosen = "rel" if mode == "relative" else "abs"
    df = df.withColumns({
        "burst_max": b["max_level"], "years_used_n": F.size("years"), "years_used_min": F.array_min("years"), "years_used_max": F.array_max("years"),
        "prev_rel_first": F.get("rel", F.lit(0)), "prev_rel_last": F.element_at("rel", -1), "count_abs_first": F.get("abs", F.lit(0)).cast("long"), "count_abs_last": F.element_at("abs", -1).cast("long"),
        "emerging": (F.col(f"mk_trend_{chosen}") == "increasing") & (F.col(f"mk_q_{chosen}") <= alpha),
    })
    return df.drop("s", "years", "rel", "abs")


def concept_trends(docs: DataFrame, alpha: float = 0.05, min_docs: int = 50, min_year_docs: int = 10) -> DataFrame:
    """Q10: docs (doc_id, year, concepts array<string>) -> trend, bursts and q-value of each concept in ``min_docs`` documents.

    The axis is the years that occur; tests run on those of ``min_year_docs`` documents, or on
    all if there are fewer than three such; bursts on the whole axis.
    """
    docs = docs.select("doc_id", "year", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"))
    totals = docs.groupBy("year").agg(F.count(F.lit(1)).alias("year_total"))
    axis = totals.agg(F.sort_array(F.collect_list(F.struct("year", "year_total"))).alias("axis"))
    each = docs.select("year", F.explode(F.array_distinct("concepts")).alias("concept"))
    counts = each.groupBy("concept", "year").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy("concept").agg(F.sum("n").alias("size")).where(F.col("size") >= min_docs)
    grid = keys.join(axis, F.lit(True)).select("concept", "size", F.inline("axis")).join(counts, ["concept", "year"], "left")
    pairs = F.sort_array(F.collect_list(F.struct("year", "year_total", F.coalesce("n", F.lit(0)).alias("n"))))
    df = grid.groupBy("concept", "size").agg(pairs.alias("s"))
    usable = F.filter("s", lambda p: p["year_total"] >= min_year_docs)
    used = F.when(F.size(usable) >= 3, usable).otherwise(F.col("s"))
    df = df.withColumn("xs", F.transform(used, lambda p: p["n"] / p["year_total"]))
    df = bh_fdr(mann_kendall(df, "xs", alpha), "mk_p", "mk_q")
    b = bursts(F.transform("s", lambda p: p["n"]))
    df = df.withColumn("b", b)
    years = F.array_join(F.transform("b.starts", lambda i: F.get("s", i)["year"].cast("string")), ";")
    return df.select("concept", "size", "mk_p", "mk_tau", "mk_trend", F.col("b.max_level").alias("burst_max"), years.alias("burst_years"), "mk_q")


def prevalence_logit(docs: DataFrame, min_docs: int = 50) -> DataFrame:
    """Q11: for each topic of ``min_docs`` documents, the coefficient of the standardised year and its p and q.

    A fit that fails, or has fewer than five documents, gives the rank correlation with the year.

    Rows weigh by (year, flag) counts: a topic's fit needs those alone, whatever the number of
    documents, so a cell table of years x flags is all that a task holds.
    """
    cells = docs.groupBy("year", "flag", "topic").agg(F.count(F.lit(1)).alias("n"))
    stat = docs.agg(F.avg("year").alias("mean"), F.stddev_pop("year").alias("std"))
    total = cells.groupBy("year", "flag").agg(F.sum("n").alias("total"))
    topics = cells.where("topic <> -1").groupBy("topic").agg(F.sum("n").alias("size")).where(F.col("size") >= min_docs)
    axis = total.join(stat, F.lit(True)).agg(F.collect_list(F.struct("year", "flag", "total", ((F.col("year") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))).alias("z"))).alias("axis"))
    grid = topics.join(axis, F.lit(True)).select("topic", F.inline("axis")).join(cells, ["topic", "year", "flag"], "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["year", "flag"])
        n, total, z = (pdf[c].to_numpy(float) for c in ("n", "total", "z"))
        method, (beta, p) = "logit", logit_cells(n, total, z, pdf["flag"].to_numpy(float))
        if n.sum() < 5 or math.isnan(p):
            method, (beta, p) = "spearman", spearman_cells(n, total, z)
        return pd.DataFrame({"topic": [pdf["topic"].iloc[0]], "method": [method], "beta_year_z": [beta], "p": [p]})

    fitted = grid.groupBy("topic").applyInPandas(fit, "topic int, method string, beta_year_z double, p double")
    return bh_fdr(fitted, "p", "q")


def logit_cells(n: np.ndarray, total: np.ndarray, x: np.ndarray, flag: np.ndarray) -> tuple[float, float]:
    """Coefficient and Wald p of x in y ~ 1 + x + flag, of cells with n successes out of total, by reweighted least squares; NaN if it can't be fitted."""
    keep = [np.ones(len(n)), x] + ([flag] if flag.min() != flag.max() else [])
    a, b = np.column_stack(keep), np.zeros(len(keep))
    h = np.eye(len(keep))
    for _ in range(50):
        m = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = a.T @ (a * (total * m * (1 - m))[:, None])
        try:
            step = np.linalg.solve(h, a.T @ (n - total * m))
        except np.linalg.LinAlgError:
            return math.nan, math.nan
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    var = np.linalg.pinv(h)[1, 1]
    return float(b[1]), math.erfc(abs(b[1]) / math.sqrt(var) / math.sqrt(2)) if var > 0 else math.nan


def spearman_cells(n: np.ndarray, total: np.ndarray, x: np.ndarray) -> tuple[float, float]:
    """Rank correlation of x and belonging, of cells with n members out of total, and its normal p; (0, 1) without variance."""
    values, at = np.unique(x, return_inverse=True)
    count = np.bincount(at, weights=total, minlength=len(values))
    rank = (np.cumsum(count) - (count - 1) / 2)[at]
    size, share = total.sum(), n.sum() / max(total.sum(), 1)
    r = rank - (rank * total).sum() / max(size, 1)
    d = math.sqrt(float((r * r * total).sum()) * size * share * (1 - share)) if size else 0.0
    if d <= 0 or size < 3:
        return 0.0, 1.0
    rho = max(-1.0, min(1.0, float((r * n).sum()) / d))
    return rho, math.erfc(abs(rho) * math.sqrt(size - 1) / math.sqrt(2))
