"""The driver's tables seen as what the operators take: documents with topics, vectors, texts, concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt over all cores and in parts of a quarter of a split at most, if its files are fewer than half the cores or are split.

    A file of long texts may be one row group or few, so one task would read and work on much of
    it, however many splits there are.
    """
    n, splits, files = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions(), len(df.inputFiles())
    return df.repartition(max(n, 4 * splits if splits > files else 0)) if 2 * files < n or splits > files else df


def dense_id(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds 0, 1 and so on in order of the distinct values of a column with few of them."""
    values = df.select(column).distinct().agg(F.sort_array(F.collect_list(column)).alias("_all"))
    return df.join(F.broadcast(values), F.lit(True)).withColumn(out, (F.array_position("_all", F.col(column)) - 1).cast("int")).drop("_all")


def doc_topics_li(spark: SparkSession, sf_dir: str, column: str = "p_type") -> DataFrame:
    """V1: a row for each line item: doc_id (not unique), year, topic (of the part; -1 if returned), flag."""
    part = dense_id(table(spark, sf_dir, "part").select("p_partkey", column), column, "t")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"])
    doc = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return rows.select(doc.alias("doc_id"), F.year("l_shipdate").alias("year"), F.when(F.col("l_returnflag") == "R", -1).otherwise(F.col("t")).alias("topic"), (F.col("l_linestatus") == "O").cast("int").alias("flag"))


def doc_topics_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: embeddings with topics (-1 for every fifth) and years."""
    e = table(spark, sf_dir, "embeddings")
    topic = F.when(F.col("vec_id") % 5 == 0, -1).otherwise(F.col("label"))
    return e.select(F.col("vec_id").alias("doc_id"), (2000 + F.col("vec_id") % 10).cast("int").alias("year"), topic.cast("int").alias("topic"), "embedding")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: texts with the number of their source as topic."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "text", "lang", F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int").alias("topic"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: events as documents of two concepts, the type and the value of k, by day."""
    e = table(spark, sf_dir, "events")
    k = F.concat(F.lit("k="), F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("doc_id"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("year"), F.array_compact(F.array("event_type", k)).alias("concepts"))


#: The same as common table expressions.
V1_SQL = """
    pt AS (SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS t FROM part),
    v1 AS (SELECT concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR) AS doc_id, year(l_shipdate)::INTEGER AS year,
                  CASE WHEN l_returnflag = 'R' THEN -1 ELSE t END AS topic, (l_linestatus = 'O')::INTEGER AS flag
           FROM lineitem JOIN pt ON l_partkey = p_partkey)"""
V3_SQL = """
    v3 AS (SELECT vec_id AS doc_id, (2000 + vec_id % 10)::INTEGER AS year, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE label END AS topic,
                  list_transform(embedding, lambda x: x::DOUBLE) AS e,
                  list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u
           FROM embeddings)"""
V5_SQL = """
    v5 AS (SELECT event_id AS doc_id, date_diff('day', DATE '2024-01-01', ts::DATE)::INTEGER AS year, [event_type, 'k=' || json_extract_string(props, '$.k')] AS concepts FROM events)"""


def centroid_sql(name: str, source: str, by: str, least: int = 1, vector: str = "e", where: str = "topic <> -1") -> str:
    """CTE name(by, n, c): unit means of vectors by group."""
    return f"""
    {name}_x AS (SELECT {by}, i, avg(x) AS m FROM (SELECT {by}, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS i FROM {source} WHERE {where}) GROUP BY {by}, i),
    {name}_l AS (SELECT {by}, list(m ORDER BY i) AS m FROM {name}_x GROUP BY {by}),
    {name}_n AS (SELECT {by}, count(*) AS n FROM {source} WHERE {where} GROUP BY {by} HAVING count(*) >= {least}),
    {name} AS (SELECT {by}, n, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS c FROM {name}_l JOIN {name}_n USING ({by}))"""
