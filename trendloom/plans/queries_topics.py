"""Queries of concepts, topic models and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions.vectors import unit
from trendloom.operators.clusters import DensityClusters, augment, fit_topics, split_topics, stability
from trendloom.operators.concepts import concept_entropy, label_index, promotable, purity, retrieve, symbolic_topics
from trendloom.operators.keys import topic_cards
from trendloom.plans.registry import query, rounded
from trendloom.plans.views import V1_SQL, V3_SQL, centroid_sql, corpus, dense_id, doc_topics_li, doc_topics_vec, table
from trendloom.providers.choosers import FirstCandidate, assign_labels, label_ids, llm_gate, refine_taxonomy
from trendloom.providers.embedders import embed


def _labels(spark, d):
    """A label for each embedding, some of them ambiguous, with its vector back to front."""
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") % 97).cast("string").alias("uri"), F.concat(F.lit("label "), (F.col("vec_id") % 101).cast("string")).alias("text"), (F.col("vec_id") % 4 == 0).alias("ambiguous"), F.reverse("embedding").alias("embedding"))


_LABEL_SQL = """
    lb AS (SELECT (vec_id % 97)::VARCHAR AS uri, 'label ' || (vec_id % 101)::VARCHAR AS text, vec_id % 4 = 0 AS ambiguous,
                  list_transform(list_reverse(embedding), lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS c FROM embeddings),
    ls AS (SELECT doc_id, uri, text, ambiguous, round(list_dot_product(u, c), 9) AS sim FROM v3, lb),
    lr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, uri, text, ambiguous) AS r FROM ls),
    lh AS (SELECT * FROM lr WHERE r <= 5 AND sim >= 0.1),
    lk AS (SELECT * FROM lh WHERE NOT ambiguous UNION ALL SELECT * FROM lh WHERE ambiguous AND EXISTS (SELECT 1 FROM lh g WHERE NOT g.ambiguous AND g.doc_id = lh.doc_id AND g.uri = lh.uri))"""


@query("m3_retrieve", f"""
    WITH {V3_SQL}, {_LABEL_SQL}, u AS (SELECT doc_id, string_agg(DISTINCT uri, ';' ORDER BY uri) AS uris FROM lk WHERE NOT ambiguous GROUP BY 1),
    t AS (SELECT doc_id, string_agg(DISTINCT text, ';' ORDER BY text) AS labels, max(sim) AS best FROM lk GROUP BY 1),
    n AS (SELECT doc_id, string_agg(uri || ':' || n, ';' ORDER BY uri) AS support FROM (SELECT doc_id, uri, count(*) AS n FROM lk WHERE NOT ambiguous GROUP BY 1, 2) GROUP BY 1)
    SELECT doc_id, coalesce(uris, '') AS uris, coalesce(labels, '') AS labels, round(best, 6) AS best, coalesce(support, '') AS support FROM v3 LEFT JOIN u USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
""")  # fmt: skip
def m3(spark, d):
    r = retrieve(doc_topics_vec(spark, d), _labels(spark, d), 5, 0.1)
    return rounded(r.select("doc_id", F.array_join("uris", ";").alias("uris"), F.array_join("labels", ";").alias("labels"), F.array_max(F.map_values("weight_label")).alias("best"), F.array_join(F.transform(F.array_sort(F.map_entries("support_uri")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";").alias("support")))


@query("m4_entropy", f"""
    WITH {V3_SQL}, {_LABEL_SQL}, w AS (SELECT doc_id, text, max(sim) AS w FROM lk GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, text) AS r, max(w) OVER (PARTITION BY doc_id) AS top FROM w),
    s AS (SELECT doc_id, list(w ORDER BY w DESC) AS ws, max(top) AS top FROM k WHERE r <= 15 AND w >= top - 0.05 GROUP BY 1),
    x AS (SELECT doc_id, list_transform(ws, lambda v: exp((v - top) / 0.07)) AS x FROM s), p AS (SELECT doc_id, list_transform(x, lambda v: v / (list_sum(x) + 1e-12)) AS p FROM x),
    h AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN -list_sum(list_transform(p, lambda v: v * ln(v + 1e-12))) ELSE 0.0 END AS h FROM p)
    SELECT v3.doc_id, round(coalesce(h, 0.0), 6) AS entropy, round(coalesce(k.w, 0.0), 6) AS cso_top1_sim, coalesce(k.text, '') AS cso_top1_label
    FROM v3 LEFT JOIN h USING (doc_id) LEFT JOIN (SELECT doc_id, w, text FROM k WHERE r = 1) k USING (doc_id)
""")  # fmt: skip
def m4(spark, d):
    r = concept_entropy(retrieve(doc_topics_vec(spark, d), _labels(spark, d), 5, 0.1))
    return rounded(r.select("doc_id", "entropy", "cso_top1_sim", "cso_top1_label"))


def _with_concepts(spark, d):
    r = concept_entropy(retrieve(doc_topics_vec(spark, d), _labels(spark, d), 5, 0.1))
    return doc_topics_vec(spark, d).join(r.select("doc_id", "entropy", "cso_top1_sim", "cso_top1_label"), "doc_id")


@query("a8_purity", """
    WITH l AS (SELECT n_regionkey AS topic, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS label FROM customer JOIN nation ON c_nationkey = n_nationkey),
    c AS (SELECT topic, label, count(*) AS n FROM l GROUP BY 1, 2), s AS (SELECT topic, sum(n) AS docs, sum(CASE WHEN label <> '' THEN n ELSE 0 END) AS labelled FROM c GROUP BY 1),
    t AS (SELECT topic, label, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, label) AS r FROM c WHERE label <> '')
    SELECT topic, docs::BIGINT AS docs, label AS top_label, round(n / labelled, 6) AS purity, round(labelled / docs, 6) AS coverage, round(n / labelled * least(1.0, labelled / docs / 0.5), 6) AS purity_eff FROM s JOIN t USING (topic) WHERE r = 1
""")  # fmt: skip
def a8(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rounded(purity(c.select(F.col("n_regionkey").alias("topic"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("cso_top1_label"))))


@query("l8_promotable", f"""
    WITH {V3_SQL}, {_LABEL_SQL}, w AS (SELECT doc_id, text, max(sim) AS w FROM lk GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, text) AS r FROM w)
    SELECT text AS label, count(*) AS n FROM k JOIN v3 USING (doc_id) WHERE r = 1 AND topic = -1 AND w >= 0.12 GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 5
""")  # fmt: skip
def l8(spark, d):
    return promotable(_with_concepts(spark, d).where("topic = -1"), 2, 0.12, 5)


@query("m9_symbolic")
def m9(spark, d):
    return symbolic_topics(_with_concepts(spark, d), 2, 0.12, 20, 0.5)[1]


@query("m1_embed")
def m1(spark, d):
    return embed(corpus(spark, d)).select("doc_id", _hashed("embedding").alias("h"))


def _hashed(vector):
    """MD5 of a vector's components in millionths."""
    return F.md5(F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ","))


@query("m5_density_topics")
def m5(spark, d):
    return rounded(fit_topics(doc_topics_vec(spark, d), DensityClusters(8, 4)))


@query("m11_augment")
def m11(spark, d):
    docs = _with_concepts(spark, d).withColumn("text", F.concat(F.lit("token"), (F.col("doc_id") % 7).cast("string"), F.lit(" shared words")))
    return augment(docs, 4, 3, label_sim=0.12).select("doc_id", "topic")


@query("m12_split")
def m12(spark, d):
    return split_topics(doc_topics_vec(spark, d), 20, 0.9, 0.0, DensityClusters(4, 2, "leaf")).select("doc_id", "topic", "parent_topic")


@query("q12_stability")
def q12(spark, d):
    return rounded(stability(doc_topics_vec(spark, d), 2, clusterer=DensityClusters(8, 4)))


@query("m7_llm_gate", f"""
    WITH {V3_SQL}, {centroid_sql("c1", "v3", "topic")}, s AS (SELECT doc_id, c1.topic, round(list_dot_product(u, c), 9) AS sim FROM v3, c1 WHERE v3.topic = -1),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic) AS r FROM s), b AS (SELECT * FROM r WHERE r = 1 AND sim > 0.05)
    SELECT v3.doc_id, CASE WHEN b.sim >= 0.1 THEN b.topic ELSE v3.topic END AS topic, b.doc_id IS NOT NULL AS llm_called, CASE WHEN v3.topic = -1 AND b.doc_id IS NULL THEN 'low_similarity' ELSE '' END AS llm_skip_reason,
           CASE WHEN b.sim >= 0.1 THEN round(b.sim, 6) END AS assignment_confidence
    FROM v3 LEFT JOIN b USING (doc_id)
""")  # fmt: skip
def m7(spark, d):
    docs = doc_topics_vec(spark, d).withColumn("text", F.col("doc_id").cast("string"))
    topics = docs.where("topic <> -1").select("topic").distinct().withColumn("label", F.concat(F.lit("topic "), F.col("topic").cast("string")))
    out = llm_gate(docs, topics, FirstCandidate(0.1), 5, 0.05)
    return rounded(out.select("doc_id", "topic", "llm_called", "llm_skip_reason", "assignment_confidence"))


@query("m18_refine_taxonomy", """
    WITH RECURSIVE e AS (SELECT vec_id AS id, 'topic ' || vec_id AS label, vec_id % 7 AS gen_freq, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u FROM embeddings WHERE vec_id % 7 >= 2),
    p AS (SELECT a.id AS u, b.id AS v FROM e a JOIN e b ON a.id < b.id WHERE round(list_dot_product(a.u, b.u), 9) >= 0.35), b AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
    r(node, c) USING KEY (node) AS (
        SELECT id, id FROM e
        UNION
        SELECT b.v, min(r.c) FROM r JOIN b ON r.node = b.u JOIN recurring.r AS o ON o.node = b.v WHERE r.c < o.c GROUP BY b.v
    )
    SELECT first(label ORDER BY gen_freq DESC, label) AS label, sum(gen_freq)::BIGINT AS gen_freq, count(*) AS members FROM r JOIN e ON e.id = r.node GROUP BY c ORDER BY 2 DESC, 1 LIMIT 500
""")  # fmt: skip
def m18(spark, d):
    topics = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("topic "), F.col("vec_id").cast("string")).alias("label"), (F.col("vec_id") % 7).alias("gen_freq"), "embedding")
    return refine_taxonomy(topics, 2, 0.35).drop("component")


@query("m19_assign", """
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) % 3 AS n FROM documents)
    SELECT doc_id, CASE WHEN n = 0 THEN 'alpha' ELSE 'Outlier' END AS topic_label, CASE WHEN n = 2 THEN 'no such quote, surely' ELSE '' END AS quote,
           CASE WHEN n = 0 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN n = 0 THEN 0 ELSE 2 END::INTEGER AS retries FROM n
""")  # fmt: skip
def m19(spark, d):
    return assign_labels(corpus(spark, d).select("doc_id", "text"), ["alpha", "beta"], _ByLength(), 2, doc_chars=0)


class _ByLength:
    """A stand-in model: by the length of the document it says a topic, one it wasn't given, or one with a quote of its own."""

    def reply(self, prompts: list[str]) -> list[str]:
        said = ['{"label": "Alpha", "quote": ""}', '{"label": "gamma", "quote": ""}', '{"label": "beta", "quote": "no such quote, surely"}']
        return [said[len(p.split("\nDocument: ", 1)[1].rpartition("\n")[0]) % 3] for p in prompts]


@query("m20_label_ids", "SELECT c_custkey, c_mktsegment AS topic_label, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS topic FROM customer")
def m20(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("topic_label"))
    return label_ids(c)


@query("m16_topic_cards", f"""
    WITH {V1_SQL}, s AS (SELECT topic, count(*) AS size, min(year) AS first_year, max(year) AS last_year FROM v1 WHERE topic <> -1 GROUP BY 1),
    f AS (SELECT topic, count(*) FILTER (flag = 1) AS flagged FROM v1 WHERE topic <> -1 GROUP BY 1), l AS (SELECT DISTINCT t AS topic, p_type AS label FROM part JOIN pt USING (p_partkey))
    SELECT topic, label, size, first_year, last_year, flagged FROM l LEFT JOIN s USING (topic) LEFT JOIN f USING (topic)
""")  # fmt: skip
def m16(spark, d):
    docs = doc_topics_li(spark, d).where("topic <> -1")
    labels = dense_id(table(spark, d, "part").select("p_type"), "p_type", "topic").groupBy("topic").agg(F.min("p_type").alias("label"))
    sizes = docs.groupBy("topic").agg(F.count(F.lit(1)).alias("size"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return topic_cards(labels, sizes, docs.groupBy("topic").agg(F.count_if(F.col("flag") == 1).alias("flagged")))


def _triples(spark, d):
    """Parts as an ontology: labels, some of them in another language, and equivalents."""
    part = table(spark, d, "part")
    uri = F.concat(F.lit("http://x/topics/p"), F.col("p_partkey").cast("string"))
    lang = F.when(F.col("p_partkey") % 5 == 0, "tr").when(F.col("p_partkey") % 2 == 0, "en")
    named = part.select(uri.alias("s"), F.lit("http://www.w3.org/2000/01/rdf-schema#label").alias("p"), F.col("p_name").alias("o"), lang.alias("lang"))
    same = part.where("p_partkey % 3 = 0").select(uri.alias("s"), F.lit("http://x/schema#relatedEquivalent"), F.concat(F.lit("http://x/topics/"), F.translate("p_brand", "# ", "__")), F.lit(None).cast("string"))
    return named.union(same)


@query("m2_label_index", """
    WITH l AS (SELECT 'http://x/topics/p' || p_partkey AS uri, p_name AS text FROM part WHERE p_partkey % 5 <> 0
               UNION SELECT 'http://x/topics/p' || p_partkey, trim(translate(translate(p_brand, '# ', '__'), '_', ' ')) FROM part WHERE p_partkey % 3 = 0),
    k AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM l WHERE length(text) >= 3), n AS (SELECT k, count(DISTINCT uri) AS n FROM k GROUP BY 1)
    SELECT uri, text, n > 1 AS ambiguous FROM k JOIN n USING (k) WHERE NOT (n > 1 AND (length(text) <= 4 OR (len(string_split(k, ' ')) = 1 AND length(text) <= 6)))
""")  # fmt: skip
def m2_index(spark, d):
    return label_index(_triples(spark, d))


@query("m2_label_vectors")
def m2(spark, d):
    """The label index, encoded."""
    return embed(label_index(_triples(spark, d))).select("uri", "text", "ambiguous", _hashed(unit("embedding")).alias("h"))
