"""Queries of trend statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trendloom.operators.trends import bh_fdr, bursts, concept_trends, mann_kendall, prevalence, prevalence_logit, series, theil_sen, topic_trends
from trendloom.plans.registry import query, rounded
from trendloom.plans.views import V1_SQL, V5_SQL, concepts, doc_topics_li, table
from trendloom.streaming.trends import replay


def erf_sql(x: str) -> str:
    """erf of x >= 0 by the series that the engine uses."""
    term = f"exp(2 * n * ln(2) + (2 * n + 1) * ln({x}) - lgamma(2 * n + 2) + lgamma(n + 1))"
    return f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} > 6 THEN 1.0 ELSE least(1.0, {2 / math.sqrt(math.pi)!r} * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 121), lambda n: {term}))) END"


def mk_sql(name: str, source: str, key: str, alpha: float = 0.05) -> str:
    """CTE name(key, p, tau, trend, slope) of a series CTE (key, t, x), the index its place in order."""
    return f"""
    {name}_i AS (SELECT {key}, x, row_number() OVER (PARTITION BY {key} ORDER BY t) - 1 AS i FROM {source}),
    {name}_s AS (SELECT a.{key}, sum(sign(b.x - a.x)) AS s, median((b.x - a.x) / (b.i - a.i)) AS slope FROM {name}_i a JOIN {name}_i b ON a.{key} = b.{key} AND a.i < b.i GROUP BY 1),
    {name}_t AS (SELECT {key}, sum(c * (c - 1) * (2 * c + 5)) AS ties, sum(c) AS n FROM (SELECT {key}, round(x, 10) AS v, count(*)::DOUBLE AS c FROM {source} GROUP BY 1, 2) GROUP BY 1),
    {name}_v AS (SELECT {key}, s, slope, n, (n * (n - 1) * (2 * n + 5) - ties) / 18 AS v FROM {name}_s JOIN {name}_t USING ({key})),
    {name}_z AS (SELECT *, CASE WHEN n < 3 OR v <= 0 THEN NULL ELSE abs(s - sign(s)) / sqrt(v) / sqrt(2.0) END AS z FROM {name}_v),
    {name}_p AS (SELECT *, CASE WHEN z IS NULL THEN 1.0 ELSE least(greatest(1.0 - ({erf_sql("z")}), 0.0), 1.0) END AS p, CASE WHEN z IS NULL THEN 0.0 ELSE s / (n * (n - 1) / 2) END AS tau FROM {name}_z),
    {name} AS (SELECT {key}, p, tau, slope, CASE WHEN p <= {alpha} AND tau > 0 THEN 'increasing' WHEN p <= {alpha} AND tau < 0 THEN 'decreasing' ELSE 'no_trend' END AS trend FROM {name}_p)"""


def bh_sql(name: str, source: str, p: str = "p") -> str:
    """CTE name: source with q."""
    return f"""
    {name}_r AS (SELECT *, row_number() OVER (ORDER BY {p}) AS r, count(*) OVER () AS m FROM {source}),
    {name} AS (SELECT *, least(1.0, min({p} * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM {name}_r)"""


_PREVALENCE_SQL = f"""{V1_SQL},
    yt AS (SELECT year, count(*) AS total FROM v1 GROUP BY 1 HAVING count(*) >= 10),
    tp AS (SELECT topic, count(*) AS size FROM v1 WHERE topic <> -1 GROUP BY 1 HAVING count(*) >= 15),
    tc AS (SELECT topic, year, count(*) AS n FROM v1 WHERE topic <> -1 GROUP BY 1, 2),
    pv AS (SELECT tp.topic, tp.size, yt.year, coalesce(tc.n, 0) AS n, yt.total AS year_total, coalesce(tc.n, 0) / yt.total AS share
           FROM tp CROSS JOIN yt LEFT JOIN tc ON tc.topic = tp.topic AND tc.year = yt.year)"""


@query("w7_prevalence", f"WITH {_PREVALENCE_SQL} SELECT topic, size::BIGINT AS size, year, n, year_total, round(share, 6) AS share FROM pv")
def w7(spark, d):
    return rounded(prevalence(doc_topics_li(spark, d), min_size=15))


@query("q8_topic_trends", f"""
    WITH {_PREVALENCE_SQL},
    rs AS (SELECT topic, year AS t, share AS x FROM pv), ab AS (SELECT topic, year AS t, n::DOUBLE AS x FROM pv),
    {mk_sql("mr", "rs", "topic")}, {bh_sql("qr", "mr")}, {mk_sql("ma", "ab", "topic")}, {bh_sql("qa", "ma")},
    e AS (SELECT topic, size, count(*) AS k, min(year) AS a, max(year) AS b, arg_min(share, year) AS r0, arg_max(share, year) AS r1, arg_min(n, year) AS n0, arg_max(n, year) AS n1 FROM pv GROUP BY 1, 2)
    SELECT e.topic, e.size::BIGINT AS topic_total_docs, round(qr.p, 6) AS mk_p_rel, round(qr.tau, 6) AS mk_tau_rel, qr.trend AS mk_trend_rel, round(qr.slope, 6) AS sen_slope_rel, round(qr.q, 6) AS mk_q_rel,
           round(qa.p, 6) AS mk_p_abs, round(qa.tau, 6) AS mk_tau_abs, qa.trend AS mk_trend_abs, round(qa.slope, 6) AS sen_slope_abs, round(qa.q, 6) AS mk_q_abs,
           e.k::INTEGER AS years_used_n, e.a AS years_used_min, e.b AS years_used_max, round(r0, 6) AS prev_rel_first, round(r1, 6) AS prev_rel_last,
           n0 AS count_abs_first, n1 AS count_abs_last, qr.trend = 'increasing' AND qr.q <= 0.05 AS emerging
    FROM e JOIN qr USING (topic) JOIN qa USING (topic)
""")  # fmt: skip
def q8(spark, d):
    return rounded(topic_trends(doc_topics_li(spark, d)).drop("burst_max"))


@query("q8_topic_trends_bursts")
def q8_bursts(spark, d):
    return rounded(topic_trends(doc_topics_li(spark, d, "p_brand")))


_DAILY_SQL = "dy AS (SELECT event_type, ts::DATE AS t, count(*)::DOUBLE AS x FROM events GROUP BY 1, 2)"


def _daily(spark, d):
    counts = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("t")).agg(F.count(F.lit(1)).alias("x"))
    return series(counts, ["event_type"], "t", "x")


@query("q1_mann_kendall", f"WITH {_DAILY_SQL}, {mk_sql('mk', 'dy', 'event_type')} SELECT event_type, round(p, 6) AS mk_p, round(tau, 6) AS mk_tau, trend AS mk_trend FROM mk")
def q1(spark, d):
    return rounded(mann_kendall(_daily(spark, d)).select("event_type", "mk_p", "mk_tau", "mk_trend"))


@query("q2_mann_kendall_tfpw", f"""
    WITH {_DAILY_SQL}, i AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS i FROM dy),
    s AS (SELECT a.event_type, median((b.x - a.x) / (b.i - a.i)) AS b FROM i a JOIN i b ON a.event_type = b.event_type AND a.i < b.i GROUP BY 1),
    f AS (SELECT event_type, i, x - b * i AS x, b FROM i JOIN s USING (event_type)),
    g AS (SELECT *, lag(x) OVER (PARTITION BY event_type ORDER BY i) AS y FROM f),
    r AS (SELECT event_type, least(0.99, greatest(-0.99, coalesce(corr(x, y), 0.0))) AS r FROM g WHERE y IS NOT NULL GROUP BY 1),
    w AS (SELECT event_type, i AS t, CASE WHEN y IS NULL THEN x ELSE x - r * y END + b * i AS x FROM g JOIN r USING (event_type)),
    {mk_sql("mk", "w", "event_type")} SELECT event_type, round(p, 6) AS mk_p, round(tau, 6) AS mk_tau, trend AS mk_trend FROM mk
""")  # fmt: skip
def q2(spark, d):
    return rounded(mann_kendall(_daily(spark, d), method="tfpw").select("event_type", "mk_p", "mk_tau", "mk_trend"))


@query("q3_mann_kendall_hamed_rao", f"""
    WITH {_DAILY_SQL}, i AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n,
                                  rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2.0 AS r FROM dy),
    l AS (SELECT a.event_type, a.n, k, coalesce(corr(a.r, b.r), 0.0) AS c FROM range(1, 11) g(k) JOIN i a ON a.n - k >= 3 JOIN i b ON a.event_type = b.event_type AND b.i = a.i + k GROUP BY 1, 2, 3),
    f AS (SELECT event_type, greatest(0.1, 1 + 2 * sum((1 - k / n) * c)) AS f FROM l GROUP BY 1),
    {mk_sql("mk", "dy", "event_type")},
    z AS (SELECT mk_z.event_type, s, n, tau, CASE WHEN v <= 0 THEN NULL ELSE abs(s - sign(s)) / sqrt(v * f) / sqrt(2.0) END AS z FROM mk_z JOIN f USING (event_type) JOIN mk USING (event_type)),
    p AS (SELECT event_type, tau, CASE WHEN z IS NULL THEN 1.0 ELSE least(greatest(1.0 - ({erf_sql("z")}), 0.0), 1.0) END AS p FROM z)
    SELECT event_type, round(p, 6) AS mk_p, round(tau, 6) AS mk_tau, CASE WHEN p <= 0.05 AND tau > 0 THEN 'increasing' WHEN p <= 0.05 AND tau < 0 THEN 'decreasing' ELSE 'no_trend' END AS mk_trend FROM p
""")  # fmt: skip
def q3(spark, d):
    return rounded(mann_kendall(_daily(spark, d), method="hamed_rao").select("event_type", "mk_p", "mk_tau", "mk_trend"))


@query("q5_theil_sen", f"""
    WITH {_DAILY_SQL}, i AS (SELECT event_type, x, date_diff('day', DATE '2024-01-01', t) AS i FROM dy)
    SELECT a.event_type, round(median((b.x - a.x) / (b.i - a.i)), 6) AS slope FROM i a JOIN i b ON a.event_type = b.event_type AND a.i < b.i GROUP BY 1
""")  # fmt: skip
def q5(spark, d):
    days = F.transform("ts", lambda t: F.date_diff(t, F.lit("2024-01-01").cast("date")))
    return rounded(_daily(spark, d).select("event_type", theil_sen(F.col("xs"), days).alias("slope")))


@query("q6_bursts")
def q6(spark, d):
    return _daily(spark, d).select("event_type", bursts(F.col("xs")).alias("b")).select("event_type", F.col("b.max_level").alias("max_level"), F.size("b.starts").alias("n_starts"), F.array_join(F.transform("b.states", lambda s: s.cast("string")), "").alias("states"))


@query("q7_bh_fdr", """
    WITH p AS (SELECT p_partkey, (p_size * 37 % 1000) / 1000.0::DOUBLE AS p FROM part), r AS (SELECT *, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS m FROM p)
    SELECT p_partkey, round(p, 6) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r
""")  # fmt: skip
def q7(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 % 1000 / F.lit(1000.0)).alias("p"))
    return rounded(bh_fdr(p, "p", "q"))


@query("q10_concept_trends", f"""
    WITH {V5_SQL},
    yt AS (SELECT year, count(*) AS total FROM v5 GROUP BY 1),
    ec AS (SELECT year, unnest(list_distinct(concepts)) AS concept FROM v5),
    cy AS (SELECT concept, year, count(*) AS n FROM ec GROUP BY 1, 2), ks AS (SELECT concept, sum(n) AS size FROM cy GROUP BY 1 HAVING sum(n) >= 50),
    s AS (SELECT ks.concept, yt.year AS t, coalesce(n, 0) / total AS x FROM ks CROSS JOIN yt LEFT JOIN cy ON cy.concept = ks.concept AND cy.year = yt.year WHERE total >= 10),
    {mk_sql("mk", "s", "concept")}, {bh_sql("q", "mk")}
    SELECT concept, size::BIGINT AS size, round(p, 6) AS mk_p, round(tau, 6) AS mk_tau, trend AS mk_trend, round(q, 6) AS mk_q FROM q JOIN ks USING (concept)
""")  # fmt: skip
def q10(spark, d):
    return rounded(concept_trends(concepts(spark, d)).drop("burst_max", "burst_years"))


@query("q10_concept_bursts")
def q10_bursts(spark, d):
    return concept_trends(concepts(spark, d)).select("concept", "size", "burst_max", "burst_years")


@query("q11_prevalence_logit")
def q11(spark, d):
    return rounded(prevalence_logit(doc_topics_li(spark, d, "p_brand")))


@query("stream_event_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS period, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream(spark, d):
    return rounded(replay(spark, f"{d}/events.parquet"))
