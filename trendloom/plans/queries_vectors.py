"""Queries of vectors, centroids and what is measured against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions.vectors import cosine, cosine_distance, dot, entropy, npmi, softmax, unit
from trendloom.operators.centroids import centroids, certainty, drift, merge_micro, near_pairs, reassign, silhouette, sweep, top_k, top_two, topic_spread
from trendloom.operators.evaluate import agreement, compare, gini, topic_entropy
from trendloom.plans.registry import query, rounded
from trendloom.plans.views import V1_SQL, V3_SQL, centroid_sql, doc_topics_li, doc_topics_vec, table

_C2 = centroid_sql("c2", "v3", "topic", 2)
_SIMS = """
    sm AS (SELECT v3.doc_id, c2.topic, round(list_dot_product(u, c), 12) AS sim FROM v3, c2 WHERE v3.topic = -1),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic) AS r FROM sm),
    tw AS (SELECT doc_id, max(topic) FILTER (r = 1) AS best_topic, max(sim) FILTER (r = 1) AS best_sim, max(sim) FILTER (r = 2) AS second_sim, coalesce(max(sim) FILTER (r = 1) - max(sim) FILTER (r = 2), 1.0) AS margin FROM rk WHERE r <= 2 GROUP BY 1)"""


@query("x1_dot_cosine", """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), f AS (SELECT e FROM e WHERE vec_id = 0)
    SELECT vec_id, round(list_dot_product(e.e, f.e), 6) AS dot, round(list_cosine_similarity(e.e, f.e), 6) AS cos, round(1 - list_cosine_similarity(e.e, f.e), 6) AS dist FROM e, f
""")  # fmt: skip
def x1(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    f = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("f")))
    j = e.join(f, F.lit(True))
    return rounded(j.select("vec_id", dot("embedding", "f").alias("dot"), cosine("embedding", "f").alias("cos"), cosine_distance("embedding", "f").alias("dist")))


@query("x5_softmax_entropy", """
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    x AS (SELECT vec_id, e, list_transform(e, lambda v: exp((v - list_max(e)) / 0.07)) AS x FROM e),
    s AS (SELECT vec_id, list_transform(x, lambda v: v / (list_sum(x) + 1e-12)) AS p FROM x)
    SELECT vec_id, round(p[1], 6) AS p1, round(-list_sum(list_transform(p, lambda v: v * ln(v + 1e-12))), 6) AS h FROM s
""")  # fmt: skip
def x5(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    p = e.select("vec_id", softmax("e", 0.07).alias("p"))
    return rounded(p.select("vec_id", F.get("p", F.lit(0)).alias("p1"), entropy("p").alias("h")))


@query("x8_gini", f"WITH {V1_SQL}, s AS (SELECT count(*) AS x FROM v1 WHERE topic <> -1 GROUP BY topic), r AS (SELECT x, row_number() OVER (ORDER BY x) AS r FROM s) SELECT round((2 * sum(r * x) / sum(x) - count(*) - 1) / count(*), 6) AS gini FROM r")
def x8(spark, d):
    return rounded(gini(doc_topics_li(spark, d)))


@query("x9_npmi", """
    WITH t AS (SELECT count(*)::DOUBLE AS n FROM orders), p AS (SELECT o_orderpriority AS a, count(*) / (SELECT n FROM t) AS pa FROM orders GROUP BY 1), s AS (SELECT o_orderstatus AS b, count(*) / (SELECT n FROM t) AS pb FROM orders GROUP BY 1),
    j AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) / (SELECT n FROM t) AS pab FROM orders GROUP BY 1, 2)
    SELECT a, b, round(ln(pab / (pa * pb) + 1e-12) / -ln(pab + 1e-12), 6) AS npmi FROM j JOIN p USING (a) JOIN s USING (b)
""")  # fmt: skip
def x9(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    n = F.broadcast(o.agg(F.count(F.lit(1)).alias("n")))
    j = o.groupBy("a", "b").agg(F.count(F.lit(1)).alias("nab")).join(o.groupBy("a").agg(F.count(F.lit(1)).alias("na")), "a").join(o.groupBy("b").agg(F.count(F.lit(1)).alias("nb")), "b").join(n, F.lit(True))
    return rounded(j.select("a", "b", npmi(F.col("na") / F.col("n"), F.col("nb") / F.col("n"), F.col("nab") / F.col("n")).alias("npmi")))


@query("a3_centroids", f"WITH {V3_SQL}, {_C2} SELECT topic, n, md5(array_to_string(list_transform(c, lambda x: round(x * 1000000)::BIGINT), ',')) AS h FROM c2")
def a3(spark, d):
    c = centroids(doc_topics_vec(spark, d).where("topic <> -1"), ["topic"], 2)
    return c.select("topic", "n", F.md5(F.array_join(F.transform("centroid", lambda x: F.round(x * 1e6).cast("long").cast("string")), ",")).alias("h"))


@query("a4_spread", f"""
    WITH {V3_SQL}, {centroid_sql("c1", "v3", "topic")}, s AS (SELECT topic, list_dot_product(u, c) AS sim FROM v3 JOIN c1 USING (topic))
    SELECT topic, count(*) AS n, round(avg(sim), 6) AS mean_sim, round(stddev_pop(sim), 6) AS std_sim FROM s GROUP BY 1
""")  # fmt: skip
def a4(spark, d):
    return rounded(topic_spread(doc_topics_vec(spark, d)))


@query("j10_nearest_two", f"WITH {V3_SQL}, {_C2}, {_SIMS} SELECT doc_id, best_topic, round(best_sim, 6) AS best_sim, round(second_sim, 6) AS second_sim, round(margin, 6) AS margin FROM tw")
def j10(spark, d):
    v = doc_topics_vec(spark, d)
    return rounded(top_two(v.where("topic = -1"), centroids(v.where("topic <> -1"), ["topic"], 2), ["doc_id"]))


@query("j11_top_k", f"""
    WITH {V3_SQL}, {_C2}, s AS (SELECT doc_id, c2.topic, round(list_dot_product(u, c), 9) AS sim FROM v3, c2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic)::INTEGER AS rank FROM s)
    SELECT doc_id, topic, rank, round(sim, 6) AS sim FROM r WHERE rank <= 3
""")  # fmt: skip
def j11(spark, d):
    v = doc_topics_vec(spark, d)
    c = centroids(v.where("topic <> -1"), ["topic"], 2).select("topic", F.col("centroid").alias("embedding"))
    return rounded(top_k(v, c, 3))


@query("j12_near_pairs", f"""
    WITH {V3_SQL}, {centroid_sql("c1", "v3", "topic")}, p AS (SELECT a.topic AS a, b.topic AS b, round(list_dot_product(a.c, b.c), 9) AS sim FROM c1 a JOIN c1 b ON a.topic < b.topic)
    SELECT a, b, round(sim, 6) AS sim FROM p WHERE sim >= 0.05
""")  # fmt: skip
def j12(spark, d):
    c = centroids(doc_topics_vec(spark, d).where("topic <> -1"), ["topic"]).select(F.col("topic").alias("id"), F.col("centroid").alias("embedding"))
    return rounded(near_pairs(c, 0.05))


@query("m6_reassign", f"""
    WITH {V3_SQL}, {_C2}, {_SIMS}, q AS (SELECT quantile_cont(margin, 0.25) AS m FROM tw WHERE best_sim >= 0.1)
    SELECT v3.doc_id, CASE WHEN best_sim >= 0.1 AND margin >= m THEN best_topic ELSE topic END AS topic, topic AS old_topic,
           CASE WHEN best_sim >= 0.1 AND margin >= m THEN 'centroid' WHEN topic = -1 THEN 'outlier' ELSE 'model' END AS assignment_source,
           CASE WHEN best_sim >= 0.1 AND margin >= m THEN round(least(greatest(best_sim * least(1.0, margin / (m + 1e-12)), 0.0), 1.0), 6) END AS assignment_confidence
    FROM v3 LEFT JOIN tw USING (doc_id), q
""")  # fmt: skip
def m6(spark, d):
    out = reassign(doc_topics_vec(spark, d), 0.1, auto_quantile=0.25)
    return rounded(out.select("doc_id", "topic", "old_topic", "assignment_source", "assignment_confidence"))


@query("q9_drift", f"""
    WITH {V3_SQL}, k AS (SELECT *, topic * 10000 + year AS k FROM v3), {centroid_sql("cy", "k", "k", 3)},
    l AS (SELECT k // 10000 AS topic, k % 10000 AS year, c, lag(c) OVER w AS p, lag(k % 10000) OVER w AS y0 FROM cy WINDOW w AS (PARTITION BY k // 10000 ORDER BY k)),
    s AS (SELECT topic, year, y0, (year - y0)::DOUBLE AS gap, least(greatest(1 - least(greatest(list_dot_product(c, p), -1.0), 1.0), 0.0), 2.0) AS step FROM l WHERE p IS NOT NULL)
    SELECT topic::INTEGER AS topic, (count(*) + 1)::INTEGER AS years_used, min(y0)::INTEGER AS first_year, max(year)::INTEGER AS last_year, round(sum(step), 6) AS drift_total_dist, round(avg(step), 6) AS drift_step_mean,
           round(avg(gap), 6) AS mean_year_gap, round(avg(step) * ln(count(*) + 2.0), 6) AS drift_robust_score, (count(*) + 1)::INTEGER AS years, round(sum(step), 6) AS drift_total_dist_raw, round(avg(step), 6) AS drift_step_mean_raw,
           0.0::DOUBLE AS missing_emb_rate, 'raw_step' AS drift_mode FROM s GROUP BY 1
""")  # fmt: skip
def q9(spark, d):
    return rounded(drift(doc_topics_vec(spark, d), 3))


@query("q14_silhouette", f"""
    WITH {V3_SQL}, o AS (SELECT doc_id, topic, u FROM v3 WHERE topic <> -1), n AS (SELECT topic, count(*) AS n FROM o GROUP BY 1),
    p AS (SELECT a.doc_id, a.topic, b.topic AS t, sum(CASE WHEN a.doc_id = b.doc_id THEN 0 ELSE 1 - list_dot_product(a.u, b.u) END) AS s FROM o a, o b GROUP BY 1, 2, 3),
    m AS (SELECT doc_id, max(CASE WHEN p.topic = t THEN s / (n - 1) END) AS a, min(CASE WHEN p.topic <> t THEN s / n END) AS b FROM p JOIN n ON n.topic = t GROUP BY 1)
    SELECT round(avg((b - a) / greatest(a, b, 1e-12)), 6) AS silhouette, count(*) AS docs FROM m
""")  # fmt: skip
def q14(spark, d):
    return rounded(silhouette(doc_topics_vec(spark, d)))


@query("q15_certainty", f"WITH {V3_SQL}, {centroid_sql('c3', 'v3', 'topic', 3)} SELECT round(avg(list_dot_product(u, c)), 6) AS certainty, count(*) AS docs FROM v3 JOIN c3 USING (topic)")
def q15(spark, d):
    return rounded(certainty(doc_topics_vec(spark, d)))


@query("q18_topic_entropy", f"""
    WITH {V1_SQL}, s AS (SELECT count(*) AS n FROM v1 WHERE topic <> -1 GROUP BY topic), p AS (SELECT n / sum(n) OVER () AS p FROM s)
    SELECT count(*) AS topics, round(-sum(p * ln(p + 1e-12)), 6) AS entropy, round(-sum(p * ln(p + 1e-12)) / ln(count(*)), 6) AS entropy_norm FROM p
""")  # fmt: skip
def q18(spark, d):
    return rounded(topic_entropy(doc_topics_li(spark, d)))


_SIMS3 = """
    sm AS (SELECT v3.doc_id, cn.topic, round(list_dot_product(u, c), 12) AS sim FROM v3, cn WHERE v3.topic = -1),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic) AS r FROM sm),
    tw AS (SELECT doc_id, max(topic) FILTER (r = 1) AS best_topic, max(sim) FILTER (r = 1) AS best_sim, max(sim) FILTER (r = 1) - max(sim) FILTER (r = 2) AS margin FROM rk WHERE r <= 2 GROUP BY 1)"""


@query("q21_sweep", f"""
    WITH {V3_SQL}, {centroid_sql("cn", "v3", "topic", 1, "u")}, {_SIMS3},
    g AS (SELECT unnest([0.05, 0.1, 0.15, 0.9]::DOUBLE[]) AS tau_sim), h AS (SELECT unnest([0.0, 0.01, 0.05]::DOUBLE[]) AS tau_mar), gr AS (SELECT * FROM g, h),
    x AS (SELECT * FROM gr JOIN tw ON best_sim >= tau_sim AND margin >= tau_mar),
    a AS (SELECT tau_sim, tau_mar, count(*) AS k, avg(best_sim) AS s1, median(best_sim) AS s2, quantile_cont(best_sim, 0.9) AS s3, avg(margin) AS m1, median(margin) AS m2, quantile_cont(margin, 0.9) AS m3 FROM x GROUP BY 1, 2),
    t AS (SELECT tau_sim, tau_mar, string_agg(best_topic || ':' || n, ';' ORDER BY n DESC, best_topic) AS top FROM (SELECT tau_sim, tau_mar, best_topic, count(*) AS n, row_number() OVER (PARTITION BY tau_sim, tau_mar ORDER BY count(*) DESC, best_topic) AS r FROM x GROUP BY 1, 2, 3) WHERE r <= 5 GROUP BY 1, 2),
    z AS (SELECT count(*) AS n, count(*) FILTER (topic = -1) AS o FROM v3)
    SELECT tau_sim, tau_mar, coalesce(k, 0) AS n_reassigned, round(s1, 6) AS mean_best_sim, round(s2, 6) AS median_best_sim, round(s3, 6) AS p90_best_sim, round(m1, 6) AS mean_margin, round(m2, 6) AS median_margin, round(m3, 6) AS p90_margin,
           coalesce(top, '') AS top5_target_topics, n AS "N", o AS n_outliers_in, o - coalesce(k, 0) AS n_outliers_out, round(1 - o / n, 6) AS coverage_base, round(1 - (o - coalesce(k, 0)) / n, 6) AS coverage_after, round(coalesce(k, 0) / n, 6) AS delta_coverage
    FROM gr LEFT JOIN a USING (tau_sim, tau_mar) LEFT JOIN t USING (tau_sim, tau_mar), z
""")  # fmt: skip
def q21(spark, d):
    return rounded(sweep(doc_topics_vec(spark, d), [0.05, 0.1, 0.15, 0.9], [0.0, 0.01, 0.05]))


@query("m13_merge_micro")
def m13(spark, d):
    return rounded(merge_micro(doc_topics_vec(spark, d), 45, 0.0)[1])


def _ami_sql(name: str, where: str = "true") -> str:
    """CTE name(n, ami) of the contingency table cell(a, b, n)."""
    g = "lgamma"
    return f"""
    {name}_c AS (SELECT a, b, n::DOUBLE AS n FROM cell WHERE {where}), {name}_n AS (SELECT sum(n) AS t FROM {name}_c),
    {name}_a AS (SELECT a, sum(n) AS i FROM {name}_c GROUP BY 1), {name}_b AS (SELECT b, sum(n) AS j FROM {name}_c GROUP BY 1),
    {name}_m AS (SELECT sum(n / t * ln(t * n / (i * j))) AS mi FROM {name}_c JOIN {name}_a USING (a) JOIN {name}_b USING (b), {name}_n),
    {name}_k AS (SELECT i, j, t, unnest(range(greatest(1, i + j - t)::BIGINT, least(i, j)::BIGINT + 1)) AS k FROM {name}_a, {name}_b, {name}_n),
    {name}_e AS (SELECT sum(k / t * ln(t * k / (i * j)) * exp({g}(i + 1) + {g}(j + 1) + {g}(t - i + 1) + {g}(t - j + 1) - {g}(t + 1) - {g}((k + 1)::DOUBLE) - {g}(i - k + 1) - {g}(j - k + 1) - {g}(t - i - j + k + 1))) AS emi FROM {name}_k),
    {name} AS (SELECT t::BIGINT AS n, (mi - emi) / (((SELECT -sum(i / t * ln(i / t)) FROM {name}_a) + (SELECT -sum(j / t * ln(j / t)) FROM {name}_b)) / 2 - emi) AS ami FROM {name}_m, {name}_e, {name}_n)"""


@query("q13_ami", f"""
    WITH cell AS (SELECT label AS a, vec_id % 10 - 1 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), {_ami_sql("w")}, {_ami_sql("o", "a <> -1 AND b <> -1")}
    SELECT 'label' AS "left", 'modulo' AS "right", w.n AS docs, round(w.ami, 6) AS ami_all, o.n AS docs_both, round(o.ami, 6) AS ami_both FROM w, o
""")  # fmt: skip
def q13(spark, d):
    e = table(spark, d, "embeddings")
    runs = {"label": e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic")), "modulo": e.select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 10 - 1).alias("topic"))}
    return rounded(agreement(runs))


@query("q20_compare", """
    WITH r AS (SELECT l_returnflag AS label, l_linenumber AS run, 'price' AS metric, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2)
    SELECT label, metric, count(DISTINCT run) AS n_runs, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS std FROM r GROUP BY 1, 2
""")  # fmt: skip
def q20(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("run")).agg(F.avg("l_extendedprice").alias("value"))
    return rounded(compare(li.withColumn("metric", F.lit("price"))))


@query("x2_unit", "SELECT vec_id, round(list_dot_product(u, u), 6) AS n, round(u[1], 6) AS u1 FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u FROM embeddings)")
def x2(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", unit("embedding").alias("u"))
    return rounded(e.select("vec_id", dot("u", "u").alias("n"), F.get("u", F.lit(0)).alias("u1")))
