"""Concepts: label index of an ontology, retrieval, entropy signal, topics discovered from labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.text import collision_key, is_english, slug, squeeze
from trendloom.functions.vectors import EPS, entropy, softmax
from trendloom.functions.vocabulary import GENERIC_CONCEPTS
from trendloom.operators.centroids import centroids, top_k
from trendloom.plans.scratch import Scratch


def label_index(triples: DataFrame, root: str = "/topics/", least: int = 3) -> DataFrame:
    """M2: (uri, text, ambiguous) of triples (s, p, o, lang).

    Labels are English literals of a label predicate, and the slugs of what the two
    equivalence predicates point at. T4: a key shared by several uris makes a label ambiguous;
    ambiguous ones are dropped if they have 4 characters or fewer, or are one word of 6 or fewer.
    """
    p = F.lower(slug(F.regexp_replace("p", "#", "/")))
    literal = triples.where(p.endswith("label") & is_english("lang")).select(F.col("s").alias("uri"), squeeze("o").alias("text"))
    same = triples.where(p.isin("preferentialequivalent", "relatedequivalent")).select(F.col("s").alias("uri"), squeeze(slug("o")).alias("text"))
    rows = literal.union(same).where(F.col("uri").contains(root) & (F.length("text") >= least)).distinct()
    return mark_ambiguous(rows)


def mark_ambiguous(labels: DataFrame) -> DataFrame:
    """T4: adds whether a label's key belongs to several uris, and drops short ambiguous labels.

    Uris are counted by key in an aggregate and joined back, as one key may be very common.
    """
    keyed = labels.withColumn("_k", collision_key("text"))
    many = keyed.groupBy("_k").agg(F.countDistinct("uri").alias("_n"))
    out = keyed.join(many, "_k").withColumn("ambiguous", F.col("_n") > 1)
    short = (F.length("text") <= 4) | ((F.size(F.split("_k", " ")) == 1) & (F.length("text") <= 6))
    return out.where(~(F.col("ambiguous") & short)).drop("_k", "_n")


def retrieve(docs: DataFrame, labels: DataFrame, k: int = 10, sim: float = 0.6) -> DataFrame:
    """(doc_id, uris, labels, weight_uri, support_uri, weight_label) of the k nearest labels (uri, text, ambiguous, embedding) of ``sim`` or more.

    A uri weighs its best hit by a clear label, and its support is how many there are; an ambiguous hit counts only for a uri that has
    one. Documents without hits have empty lists; k of 0 or less gives no hits. Hits are written,
    as they are read several times.
    """
    hits = Scratch(docs.sparkSession, "retrieve").save(top_k(docs, labels, max(k, 0)).where(F.col("sim") >= sim), "hits")
    clear = hits.where(~F.col("ambiguous")).select("doc_id", "uri").distinct()
    kept = hits.where(~F.col("ambiguous")).unionByName(hits.where("ambiguous").join(clear, ["doc_id", "uri"], "left_semi").select(*hits.columns))
    by_uri = kept.where(~F.col("ambiguous")).groupBy("doc_id", "uri").agg(F.max("sim").alias("w"), F.count(F.lit(1)).alias("support"))
    by_text = kept.groupBy("doc_id", "text").agg(F.max("sim").alias("w"))
    u = by_uri.groupBy("doc_id").agg(F.sort_array(F.collect_list("uri")).alias("uris"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("uri", "w")))).alias("weight_uri"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("uri", "support")))).alias("support_uri"))
    t = by_text.groupBy("doc_id").agg(F.sort_array(F.collect_list("text")).alias("labels"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("text", "w")))).alias("weight_label"))
    out = docs.select("doc_id").distinct().join(u, "doc_id", "left").join(t, "doc_id", "left")
    none, weights = F.array().cast("array<string>"), F.create_map().cast("map<string,double>")
    return out.select("doc_id", F.coalesce("uris", none).alias("uris"), F.coalesce("labels", none).alias("labels"), F.coalesce("weight_uri", weights).alias("weight_uri"), F.coalesce("support_uri", F.create_map().cast("map<string,long>")).alias("support_uri"), F.coalesce("weight_label", weights).alias("weight_label"))


def concept_entropy(df: DataFrame, weights: str = "weight_label", top: int = 15, margin: float = 0.05, temperature: float = 0.07) -> DataFrame:
    """M4: adds entropy, cso_top1_sim and cso_top1_label of a map of weights.

    L4: the ``top`` heaviest, of those within ``margin`` of the first; entropy of their softmax.
    Without weights: 0, 0 and the empty string. Ties go to the smaller label.
    """
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce(F.col(weights), F.create_map().cast("map<string,double>"))), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("label"))))
    df = df.withColumn("_e", F.slice(entries, 1, top))
    first = F.get("_e", F.lit(0))
    df = df.withColumn("_s", F.transform(F.filter("_e", lambda e: -e["m"] >= -first["m"] - margin), lambda e: -e["m"]))
    h = F.when(F.size("_s") > 1, entropy(softmax("_s", temperature))).otherwise(0.0)
    return df.withColumns({"entropy": h, "cso_top1_sim": F.coalesce(-first["m"], F.lit(0.0)), "cso_top1_label": F.coalesce(first["label"], F.lit(""))}).drop("_e", "_s")


def promotable(residual: DataFrame, least: int = 6, sim: float = 0.65, most: int = 250) -> DataFrame:
    """(label, n): specific top labels of ``least`` documents of ``sim`` or more, the ``most`` most frequent."""
    label = F.lower(F.trim("cso_top1_label"))
    fine = residual.where((label != "") & ~label.isin(GENERIC_CONCEPTS) & (F.col("cso_top1_sim") >= sim))
    counts = fine.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "label").limit(most)


def symbolic_topics(docs: DataFrame, least: int = 6, sim: float = 0.65, most: int = 250, merge: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """M9: docs with outliers given to topics named by their top labels, and the table (topic, label, size, merged).

    In order of frequency, a label whose centroid is within ``merge`` of a topic of more than
    two documents, or of a label before it, goes there; else it gets the next id. Only
    centroids, one for each label and topic, reach the driver.
    """
    spark = docs.sparkSession
    outliers = docs.where("topic = -1").withColumn("label", F.lower(F.trim("cso_top1_label")))
    chosen = promotable(outliers, least, sim, most)
    fine = outliers.where(F.col("cso_top1_sim") >= sim).join(F.broadcast(chosen.select("label")), "label", "left_semi")
    fresh = {r["label"]: (r["n"], np.array(r["centroid"])) for r in centroids(fine, ["label"]).collect()}
    old = [(r["topic"], np.array(r["centroid"])) for r in centroids(docs.where("topic <> -1"), ["topic"], 3).orderBy("topic").collect()]
    next_id = (docs.agg(F.max("topic")).first()[0] or 0) + 1
    rows = []
    for label in sorted(fresh, key=lambda k: (-fresh[k][0], k)):
        n, c = fresh[label]
        best = max(old, key=lambda t: (round(float(t[1] @ c) / max(float(np.linalg.norm(t[1])), EPS), 9), -t[0]), default=None)
        if best is not None and float(best[1] @ c) >= merge:
            rows.append((int(best[0]), label, int(n), True))
        else:
            rows.append((int(next_id), label, int(n), False))
            old.append((next_id, c))
            next_id += 1
    table = spark.createDataFrame(rows, "topic int, label string, size long, merged boolean")
    to = F.broadcast(table.select(F.col("topic").alias("_to"), F.col("label").alias("_label")))
    match = (F.lower(F.trim("cso_top1_label")) == F.col("_label")) & (F.col("topic") == -1) & (F.col("cso_top1_sim") >= sim)
    return docs.join(to, match, "left").withColumn("topic", F.coalesce("_to", "topic")).drop("_to", "_label"), table


def purity(docs: DataFrame, label: str = "cso_top1_label", target: float = 0.5) -> DataFrame:
    """(topic, top_label, purity, coverage, purity_eff): the most frequent label's share among labelled documents."""
    own = docs.where("topic <> -1").select("topic", F.coalesce(F.col(label), F.lit("")).alias("label"))
    counts = own.groupBy("topic", "label").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("label") != ""
    out = counts.groupBy("topic").agg(F.sum("n").alias("docs"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("labelled"), F.min(F.when(named, F.struct((-F.col("n")).alias("m"), "label"))).alias("top"))
    share = F.when(F.col("labelled") > 0, -F.col("top.m") / F.when(F.col("labelled") > 0, F.col("labelled")).otherwise(1)).otherwise(0.0)
    out = out.select("topic", "docs", F.coalesce("top.label", F.lit("")).alias("top_label"), share.alias("purity"), (F.col("labelled") / F.col("docs")).alias("coverage"))
    return out.withColumn("purity_eff", F.col("purity") * F.least(F.lit(1.0), F.col("coverage") / target))
