"""Queries of what puts the others together."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators.centroids import drift
from trendloom.operators.evaluate import evaluate_run
from trendloom.operators.trends import topic_trends
from trendloom.plans.queries_text import COHERENCE_SQL, coherence_keywords
from trendloom.plans.registry import ORACLES, query, rounded
from trendloom.plans.views import V3_SQL, corpus, doc_topics_li, doc_topics_vec


def _of(name: str, expression: str, where: str = "true") -> str:
    return f"(SELECT {expression} FROM ({ORACLES[name]}) WHERE {where})"


@query("q19_evaluate", f"""
    WITH {V3_SQL}, {COHERENCE_SQL}, n AS (SELECT count(*) AS n, count(DISTINCT CASE WHEN topic <> -1 THEN topic END) AS t, count(*) FILTER (topic = -1) AS o FROM v3),
    z AS (SELECT count(*) AS n FROM v3 WHERE topic <> -1 GROUP BY topic), p AS (SELECT n / sum(n) OVER () AS p FROM z), h AS (SELECT -sum(p * ln(p + 1e-12)) AS h, count(*) AS k FROM p)
    SELECT 'docs' AS metric, n::DOUBLE AS value FROM n UNION ALL SELECT 'topics', t FROM n UNION ALL SELECT 'outliers', o FROM n UNION ALL SELECT 'coverage', round(1 - o / n, 6) FROM n
    UNION ALL SELECT 'entropy', round(h, 6) FROM h UNION ALL SELECT 'entropy_norm', round(h / ln(k), 6) FROM h
    UNION ALL SELECT 'diversity', round(count(DISTINCT term) / count(*), 6) FROM kw WHERE rank <= 10
    UNION ALL SELECT 'coherence_cv', round(avg(c_v), 6) FROM coh UNION ALL SELECT 'coherence_npmi', round(avg(c_npmi), 6) FROM coh
    UNION ALL SELECT 'silhouette', {_of("q14_silhouette", "silhouette")} UNION ALL SELECT 'certainty', {_of("q15_certainty", "certainty")}
    UNION ALL SELECT 'emerging_topics_count', {_of("q8_topic_trends", "count(*)", "mk_trend_rel = 'increasing'")}
    UNION ALL SELECT 'avg_semantic_drift', round({_of("q9_drift", "avg(drift_robust_score)")}, 4)
    UNION ALL SELECT 'wall_clock_seconds', 12.5 UNION ALL SELECT 'llm_calls', 3
""")  # fmt: skip
def q19(spark, d):
    v, texts = doc_topics_vec(spark, d), corpus(spark, d).select("doc_id", "text")
    out = evaluate_run(v, texts, coherence_keywords(spark, d), topic_trends(doc_topics_li(spark, d)), drift(v, 3), {"wall_clock_seconds": 12.5, "llm_calls": 3}, min_df=1)
    return rounded(out.withColumn("value", F.when(F.col("metric") == "avg_semantic_drift", F.round("value", 4)).otherwise(F.col("value"))))
