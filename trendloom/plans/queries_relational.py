"""Queries of keys, joins, aggregates, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.text import foreign_letters, parse_year, stable_id
from trendloom.operators.components import connected_components
from trendloom.operators.evaluate import by_source, contingency, coverage, stratified
from trendloom.operators.keys import align, backfill, examples, is_doctorate, topic_cards, unique_ids, z_score
from trendloom.plans.registry import query, rounded
from trendloom.plans.scratch import Scratch
from trendloom.plans.views import V1_SQL, V3_SQL, doc_topics_li, doc_topics_vec, table
from trendloom.sources.tables import read_csv, read_jsonl, write_csv, write_jsonl


@query("s1_csv_scan", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer")
def s1(spark, d):
    path = Scratch(spark, "csv").path("customer")
    write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), path)
    return read_csv(spark, path)


@query("s7_jsonl_scan", "SELECT event_id, event_type, user_id, value FROM events")
def s7(spark, d):
    path = Scratch(spark, "jsonl").path("events")
    write_jsonl(table(spark, d, "events").select("event_id", "event_type", "user_id", "value"), path)
    return read_jsonl(spark, path, "event_id long, event_type string, user_id long, value double")


@query("p1_stable_id", "SELECT c_custkey, sha1(concat(coalesce(c_name, ''), '|', coalesce(c_mktsegment, ''), '|', coalesce(c_nationkey::VARCHAR, ''))) AS doc_id FROM customer")
def p1(spark, d):
    return table(spark, d, "customer").select("c_custkey", stable_id("c_name", "c_mktsegment", "c_nationkey").alias("doc_id"))


@query("p2_unique_ids", """
    WITH k AS (SELECT l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS k, l_partkey, l_suppkey, l_quantity,
                      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS n FROM lineitem)
    SELECT CASE WHEN n > 0 THEN k || '__dup' || n::VARCHAR ELSE k END AS doc_id, l_partkey, l_suppkey, l_quantity FROM k
""")  # fmt: skip
def p2(spark, d):
    li = table(spark, d, "lineitem").withColumn("doc_id", F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")))
    order = [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return unique_ids(li, "doc_id", order).select("doc_id", "l_partkey", "l_suppkey", "l_quantity")


@query("p6_foreign_letters", "SELECT doc_id, (length(text) - length(translate(text, 'çğıöşüÇĞİÖŞÜ', '')))::INTEGER AS letters, length(text) - length(translate(text, 'çğıöşüÇĞİÖŞÜ', '')) > 3 AS flag FROM documents")
def p6(spark, d):
    n = foreign_letters("text")
    return table(spark, d, "documents").select("doc_id", n.alias("letters"), (n > 3).alias("flag"))


@query("p8_years", "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY 1")
def p8(spark, d):
    y = parse_year(F.concat(F.year("o_orderdate").cast("string"), F.lit(".0")))
    return table(spark, d, "orders").select(y.alias("year")).where("year > 1000").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query("p12_clip_p13_where", "SELECT s_suppkey, round(least(greatest(s_acctbal, 0.0), 5000.0), 6) AS clipped, CASE WHEN s_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side FROM supplier")
def p12(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", F.round(F.least(F.greatest("s_acctbal", F.lit(0.0)), F.lit(5000.0)), 6).alias("clipped"), F.when(F.col("s_acctbal") < 0, "debt").otherwise("credit").alias("side"))


@query("p14_align", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, '' AS n_comment FROM nation")
def p14(spark, d):
    return align(table(spark, d, "nation"), ["n_nationkey", "n_name", "n_comment"])


@query("p15_doctorate", "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'doctor|dokto|phd') THEN 1 ELSE 0 END AS flag FROM documents")
def p15(spark, d):
    return table(spark, d, "documents").select("doc_id", is_doctorate("text").alias("flag"))


@query("p16_z_score", "SELECT doc_id, round((n_chars - (SELECT avg(n_chars) FROM documents)) / (SELECT stddev_pop(n_chars) FROM documents), 6) AS z FROM documents")
def p16(spark, d):
    return rounded(z_score(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "z").select("doc_id", "z"))


@query("j1_inner_text", "SELECT d.doc_id, l.quality, d.n_chars FROM documents d JOIN labels l USING (doc_id)")
def j1(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", "n_chars")


@query("j2_left_stats", "SELECT d.doc_id, l.quality, coalesce(l.toxic, 0)::INTEGER AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j2(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("j4_backfill", "SELECT l.doc_id, l.quality, d.lang, d.source FROM labels l LEFT JOIN (SELECT doc_id, min(lang) AS lang, min(source) AS source FROM documents GROUP BY 1) d USING (doc_id)")
def j4(spark, d):
    return backfill(table(spark, d, "labels"), table(spark, d, "documents"), ["lang", "source"]).select("doc_id", "quality", "lang", "source")


@query("j5_topic_cards", """
    SELECT n_nationkey AS topic, n_name AS label, c.customers, s.suppliers FROM nation
    LEFT JOIN (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
""")  # fmt: skip
def j5(spark, d):
    topics = table(spark, d, "nation").select(F.col("n_nationkey").alias("topic"), F.col("n_name").alias("label"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("topic")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("topic")).agg(F.count(F.lit(1)).alias("suppliers"))
    return topic_cards(topics, c, s)


@query("j8_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j8(spark, d):
    rich = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(rich, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("j9_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j9(spark, d):
    rich = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(rich, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("a1_topic_sizes", f"WITH {V1_SQL} SELECT topic, count(*) AS n FROM v1 GROUP BY 1")
def a1(spark, d):
    return doc_topics_li(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


_YEARS = range(1995, 2002)


@query("a2_pivot", f"WITH {V1_SQL} SELECT topic, " + ", ".join(f"count(*) FILTER (year = {y}) AS y{y}" for y in _YEARS) + " FROM v1 GROUP BY 1")
def a2(spark, d):
    wide = doc_topics_li(spark, d).groupBy("topic").pivot("year", list(_YEARS)).count().fillna(0)
    return wide.select("topic", *[F.col(str(y)).alias(f"y{y}") for y in _YEARS])


@query("a6_quantiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(median(o_totalprice), 6) AS median, round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders GROUP BY 1")
def a6(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority")
    return rounded(o.agg(F.percentile("o_totalprice", 0.1).alias("p10"), F.median("o_totalprice").alias("median"), F.percentile("o_totalprice", 0.9).alias("p90")))


@query("a10_coverage", f"WITH {V1_SQL} SELECT count(*) AS docs, count(DISTINCT CASE WHEN topic <> -1 THEN topic END) AS topics, count(*) FILTER (topic = -1) AS outliers, round(1 - count(*) FILTER (topic = -1) / count(*), 6) AS coverage FROM v1")
def a10(spark, d):
    return rounded(coverage(doc_topics_li(spark, d)))


@query("a15_by_source", """
    SELECT o_orderstatus AS source, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.1), 4) AS p10,
           round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.9), 4) AS p90
    FROM orders GROUP BY 1
""")  # fmt: skip
def a15(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), "o_totalprice")
    return rounded(by_source(rows, "o_totalprice", "source"), 4)


@query("a16_contingency", "SELECT label AS a, (vec_id % 10)::INTEGER AS b, count(*) AS n FROM embeddings GROUP BY 1, 2")
def a16(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return contingency(e.select("doc_id", F.col("label").alias("topic")), e.select("doc_id", (F.col("doc_id") % 10).cast("int").alias("topic")))


@query("w2_average_rank", "SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0)::DOUBLE AS r FROM part")
def w2(spark, d):
    w = Window.partitionBy("p_brand")
    r = F.rank().over(w.orderBy("p_size")) + (F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_size")) - 1) / F.lit(2.0)
    return table(spark, d, "part").select("p_partkey", r.alias("r"))


@query("w7_share", f"WITH {V1_SQL}, c AS (SELECT year, topic, count(*) AS n FROM v1 GROUP BY 1, 2) SELECT year, topic, n, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM c")
def w7(spark, d):
    c = doc_topics_li(spark, d).groupBy("year", "topic").agg(F.count(F.lit(1)).alias("n"))
    return rounded(c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("year"))))


@query("w9_stratified", f"""
    WITH {V3_SQL}, r AS (SELECT doc_id, topic, md5(doc_id::VARCHAR || ':42') AS h FROM v3 WHERE topic <> -1),
    k AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY h, doc_id) AS r FROM r)
    SELECT doc_id, topic FROM k WHERE r <= 20 ORDER BY h, doc_id LIMIT 150
""")  # fmt: skip
def w9(spark, d):
    return stratified(doc_topics_vec(spark, d), 20, 150).select("doc_id", "topic")


@query("w10_first_last", "SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY 1")
def w10(spark, d):
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


@query("l5_examples", f"""
    WITH {V3_SQL}, r AS (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY year DESC, e[1] DESC, doc_id) AS rank FROM v3 WHERE topic <> -1)
    SELECT topic, doc_id, rank::INTEGER AS rank FROM r WHERE rank <= 3
""")  # fmt: skip
def l5(spark, d):
    rows = doc_topics_vec(spark, d).withColumn("assignment_confidence", F.get("embedding", F.lit(0)).cast("double"))
    return examples(rows, 3, recent=True).select("topic", "doc_id", "rank")


@query("l7_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def l7(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("u1_union", "SELECT n_name AS name, n_regionkey AS region, NULL::VARCHAR AS kind FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region")
def u1(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    return n.unionByName(r, allowMissingColumns=True)


@query("u3_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def u3(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("u4_components", """
    WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS u, l_partkey + 1000000000 AS v FROM lineitem), b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    r(node, c) USING KEY (node) AS (
        SELECT DISTINCT u, u FROM b
        UNION
        SELECT b.v, min(r.c) FROM r JOIN b ON r.node = b.u JOIN recurring.r AS o ON o.node = b.v WHERE r.c < o.c GROUP BY b.v
    )
    SELECT node, c AS component FROM r
""")  # fmt: skip
def u4(spark, d):
    li = table(spark, d, "lineitem")
    return connected_components(li.select(F.col("l_suppkey").alias("u"), (F.col("l_partkey") + 1000000000).alias("v")))
