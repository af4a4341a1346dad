"""The main run: from a corpus to topics, keywords, trends and figures, each stage's table written to the run's folder."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.vocabulary import STOP_WORDS
from trendloom.operators import centroids, clusters, concepts, evaluate, keys, keywords, trends
from trendloom.providers.choosers import Chooser, assign_labels, discover, label_ids, llm_gate, refine_taxonomy, taxonomy_text
from trendloom.providers.embedders import Embedder, embed
from trendloom.sources.tables import align_vectors, write_vectors


@dataclass
class Config:
    """Parameters of a run by stage; the defaults are those of a corpus of some ten thousand documents."""

    concept_topk: int = 10
    concept_sim: float = 0.6
    entropy_topm: int = 15
    entropy_margin: float = 0.05
    entropy_temperature: float = 0.07
    min_cluster_size: int = 50
    min_samples: int = 10
    components: int = 5
    sample: int = clusters.SAMPLE
    reassign_sim: float = 0.75
    reassign_margin: float = 0.0
    reassign_margin_quantile: float | None = None
    gate_sim: float | None = None
    gate_entropy: float = 0.5
    gate_entropy_quantile: float | None = None
    max_outliers: int = 0
    llm_topk: int = 5
    llm_floor: float = 0.55
    augment: bool = True
    augment_min_cluster_size: int = 8
    augment_min_samples: int = 3
    augment_purity: float = 0.0
    split: bool = True
    split_min_size: int = 200
    split_mean_sim: float = 0.60
    split_std_sim: float = 0.12
    split_duplicate: float = 0.90
    merge_micro: bool = False
    merge_min_size: int = 10
    merge_sim: float = 0.85
    final_cleanup: bool = True
    min_df: int = 5
    keywords: int = 15
    refine_keywords: bool = True
    weighting: str = "none"
    trend_alpha: float = 0.05
    mk_method: str = "classic"
    mk_lag_max: int | None = 10
    prevalence_mode: str = "relative"
    trend_min_topic_size: int = 15
    min_year_docs: int = 10
    min_docs_shift: int = 5
    emerging_if_burst: bool = False
    stability_runs: int = 0
    seed: int = 42


class _Counting:
    """A chooser that counts its prompts where they are asked."""

    def __init__(self, chooser: Chooser, asked):
        self.chooser, self.asked = chooser, asked

    def reply(self, prompts: list[str]) -> list[str]:
        self.asked.add(len(prompts))
        return self.chooser.reply(prompts)


def finish(spark: SparkSession, out, docs: DataFrame, labels: DataFrame, c: Config) -> tuple[DataFrame, DataFrame]:
    """Stages 8 to 11: final topics with keywords, trends, drift, prevalence; ``out(df, name)`` writes a table and reads it back."""
    weight = F.col("assignment_confidence") if c.weighting == "confidence" else None
    final = out(docs.select("doc_id", "year", "topic", "flag", "assignment_source", "assignment_confidence"), "09_final_doc_topics")
    topics = out(keywords.finalize(docs, labels, c.keywords, c.min_df, STOP_WORDS, weight), "09_final_topics_raw" if c.refine_keywords else "09_final_topics")
    if c.refine_keywords:
        refined = keywords.refine(docs, topics, min_df=c.min_df, stop=STOP_WORDS)
        topics = out(topics.join(refined, "topic", "left"), "09_final_topics")
    dated = final.where("year is not null")
    t = trends.topic_trends(dated, c.trend_alpha, c.trend_min_topic_size, c.min_year_docs, c.mk_method, c.mk_lag_max, c.prevalence_mode)
    if c.emerging_if_burst:
        t = t.withColumn("emerging", F.col("emerging") & (F.col("burst_max") >= 2))
    t = out(t.join(topics.select("topic", F.col("label").alias("topic_label")), "topic", "left"), "10_topic_trends")
    out(t.where("emerging"), "10_emerging_topics")
    shift = centroids.drift(docs.where("year is not null"), c.min_docs_shift, by_gap=True)
    out(shift.join(topics.select("topic", "label"), "topic", "left"), "11_semantic_shift")
    out(trends.prevalence_logit(dated), "13_prevalence_baseline")
    return final, topics


def run(spark: SparkSession, corpus: DataFrame, run_dir: str, c: Config | None = None, embedder: Embedder | None = None, vectors: DataFrame | None = None, labels: DataFrame | None = None, chooser: Chooser | None = None) -> dict[str, str]:
    """The whole model on a corpus (doc_id, year, text[, thesis_type]); the paths of its tables by name.

    ``labels`` (uri, text, ambiguous, embedding) are the ontology's; without them no stage uses
    concepts. ``vectors`` (doc_id, embedding) are used where they hold a document, others are
    encoded. Without a ``chooser`` nothing is put to a language model. Rows without a doc_id go;
    null texts count as empty; where a doc_id repeats, the second and later ones get a suffix.
    """
    c = c or Config()
    began = time.time()
    paths: dict[str, str] = {}

    def out(df: DataFrame, name: str) -> DataFrame:
        paths[name] = f"{run_dir}/{name}.parquet"
        df.write.mode("overwrite").parquet(paths[name])
        return spark.read.parquet(paths[name])

    flag = keys.is_doctorate("thesis_type") if "thesis_type" in corpus.columns else F.lit(0)
    docs = corpus.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("year").cast("int").alias("year"), F.coalesce("text", F.lit("")).alias("text"), flag.alias("flag"))
    docs = out(keys.unique_ids(docs, "doc_id", [F.xxhash64("text", "year"), F.col("text")]), "01_preprocessed_documents")
    write_vectors(align_vectors(docs, vectors, lambda d: embed(d, embedder)), f"{run_dir}/embeddings.parquet")
    paths["embeddings"] = f"{run_dir}/embeddings.parquet"
    docs = docs.join(spark.read.parquet(paths["embeddings"]), "doc_id")

    none = {"entropy": F.lit(None).cast("double"), "cso_top1_sim": F.lit(0.0), "cso_top1_label": F.lit("")}
    held = None
    if labels is not None:
        held = out(concepts.retrieve(docs, labels, c.concept_topk, c.concept_sim), "02_cso_concepts")
        stats = concepts.concept_entropy(held, top=c.entropy_topm, margin=c.entropy_margin, temperature=c.entropy_temperature)
        stats = out(stats.select("doc_id", "entropy", "cso_top1_sim", "cso_top1_label"), "03_cso_entropy_stats")
        docs = docs.join(stats, "doc_id", "left")
    else:
        docs = docs.withColumns(none)

    base = clusters.fit_topics(docs.select("doc_id", "embedding"), clusters.DensityClusters(c.min_cluster_size, c.min_samples), c.components, c.sample, c.seed)
    base = out(base, "04_bertopic_doc_topics")
    state = docs.join(base.select("doc_id", "topic", F.col("probability").alias("assignment_confidence")), "doc_id").withColumn("assignment_confidence", F.when(F.col("topic") != -1, F.col("assignment_confidence")))
    named = lambda s: keywords.finalize(s, s.select("topic").distinct().withColumn("label", F.lit("")), c.keywords, c.min_df, STOP_WORDS)
    topics = out(named(state), "04_bertopic_topics")
    gate = (c.gate_sim, c.gate_entropy) if c.gate_sim is not None and labels is not None else None

    def moved(s: DataFrame, name: str) -> DataFrame:
        re = centroids.reassign(s, c.reassign_sim, c.reassign_margin, c.reassign_margin_quantile, gate, most=c.max_outliers, gate_quantile=c.gate_entropy_quantile)
        return out(re.drop("old_topic", "similarity_score", "similarity_margin"), name)

    def source(s: DataFrame, before: DataFrame, name: str) -> DataFrame:
        """Marks what a stage gave a topic."""
        was = before.select("doc_id", F.col("topic").alias("_was"))
        new = (F.col("_was") == -1) & (F.col("topic") != -1)
        return s.join(was, "doc_id", "left").withColumn("assignment_source", F.when(new, name).otherwise(F.col("assignment_source"))).drop("_was")

    state = moved(state, "06_reassigned_doc_topics")
    asked = spark.sparkContext.accumulator(0)
    gated = llm_gate(state, topics, None if chooser is None else _Counting(chooser, asked), c.llm_topk, c.llm_floor, gate, c.gate_entropy_quantile, c.max_outliers)
    state = out(source(gated, state, "llm").drop("llm_called", "llm_skip_reason"), "07_llm_gated_doc_topics")
    llm_calls = asked.value
    if c.augment:
        more = clusters.augment(state, c.augment_min_cluster_size, c.augment_min_samples, pure=c.augment_purity, sample=c.sample)
        state = out(source(more, state, "augment"), "08_augmented_doc_topics")
    if c.split:
        state = out(clusters.split_topics(state, c.split_min_size, c.split_mean_sim, c.split_std_sim, duplicate=c.split_duplicate, sample=c.sample).drop("parent_topic"), "08_split_doc_topics")
    if c.merge_micro:
        state, map_ = centroids.merge_micro(state, c.merge_min_size, c.merge_sim)
        state = out(state, "08_micro_merged_doc_topics")
        out(map_, "08_micro_merge_map")
    if c.final_cleanup:
        state = moved(state, "08b_final_cleanup_doc_topics")
    # Topics keep their label while their number stands for the topic found first; new ones are labelled by their keywords.
    labelled = state.select("topic").distinct().join(topics.select("topic", "label"), "topic", "left").withColumn("label", F.coalesce("label", F.lit("")))
    final, topics = finish(spark, out, state, labelled, c)
    if held is not None:
        out(trends.concept_trends(final.where("year is not null").join(held.select("doc_id", F.col("labels").alias("concepts")), "doc_id", "left"), c.trend_alpha), "12_cso_concept_trends")
    if c.stability_runs > 0:
        out(clusters.stability(docs.select("doc_id", "embedding"), c.stability_runs, c.seed, clusters.DensityClusters(c.min_cluster_size, c.min_samples), c.sample), "13_model_stability")
    figures = {"wall_clock_seconds": time.time() - began, "llm_calls": float(llm_calls)} | {f"config_{k}": float(v) for k, v in asdict(c).items() if isinstance(v, bool | int | float)}
    out(spark.createDataFrame(list(figures.items()), "metric string, value double"), "14_run_metrics")
    return paths


def bare(spark: SparkSession, corpus: DataFrame, run_dir: str, c: Config | None = None, **given) -> dict[str, str]:
    """The baseline without concepts, language model or governance: topics of the clustering, their keywords and trends."""
    c = Config(**(asdict(c or Config()) | {"augment": False, "split": False, "merge_micro": False, "final_cleanup": False, "reassign_sim": 2.0}))
    return run(spark, corpus, run_dir, c, **{k: v for k, v in given.items() if k not in ("labels", "chooser")})


def llm_baseline(
    spark: SparkSession, corpus: DataFrame, run_dir: str, chooser: Chooser, c: Config | None = None, embedder: Embedder | None = None, most: int = 500, gen_docs: int = 1000, min_freq: int = 2, sim: float = 0.85, doc_chars: int = 1200, retries: int = 5
) -> dict[str, str]:
    """Topics named by a language model alone: discovered over ``gen_docs`` texts in seeded order, refined by their labels' vectors, given to every document.

    Discovery is a conversation, each turn with the topics so far, so it runs on the driver over
    that many texts at most; assignment runs where the texts are.
    """
    c = c or Config()
    began, paths = time.time(), {}

    def out(df: DataFrame, name: str) -> DataFrame:
        paths[name] = f"{run_dir}/{name}.parquet"
        df.write.mode("overwrite").parquet(paths[name])
        return spark.read.parquet(paths[name])

    flag = keys.is_doctorate("thesis_type") if "thesis_type" in corpus.columns else F.lit(0)
    docs = corpus.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("year").cast("int").alias("year"), F.coalesce("text", F.lit("")).alias("text"), flag.alias("flag"))
    docs = out(keys.unique_ids(docs, "doc_id", [F.xxhash64("text", "year"), F.col("text")]), "01_preprocessed_documents")
    asked = spark.sparkContext.accumulator(0)
    counting = _Counting(chooser, asked)
    shown = F.substring("text", 1, doc_chars) if doc_chars > 0 else F.col("text")
    texts = [r[0] for r in docs.orderBy(F.xxhash64("doc_id", F.lit(c.seed)), "doc_id").limit(gen_docs).select(shown.alias("t")).collect()]
    turns = [0]

    def one(prompt: str) -> str:
        turns[0] += 1
        return chooser.reply([prompt])[0]

    found = discover(iter(texts), one, most=most)
    schema = "id long, label string, desc string, keywords string, gen_freq long"
    table = spark.createDataFrame([(i, t["label"], t["desc"], t["keywords"], t["gen_freq"]) for i, t in enumerate(found)], schema)
    refined = refine_taxonomy(embed(table, embedder, "label"), min_freq, sim, most)
    kept = {r["label"] for r in out(refined, "02_llm_taxonomy").collect()}  # at most ``most``
    chosen = [t for t in found if t["label"] in kept]
    assigned = assign_labels(docs.select("doc_id", "text"), [t["label"] for t in chosen], counting, retries, doc_chars, taxonomy_text(chosen))
    assigned = out(label_ids(assigned), "03_llm_assignments")
    vectors = embed(docs, embedder)
    write_vectors(vectors, f"{run_dir}/embeddings.parquet")
    paths["embeddings"] = f"{run_dir}/embeddings.parquet"
    state = docs.join(assigned.select("doc_id", "topic", "topic_label"), "doc_id").join(spark.read.parquet(paths["embeddings"]), "doc_id")
    state = state.withColumns({"assignment_source": F.when(F.col("topic") == -1, "outlier").otherwise("llm"), "assignment_confidence": F.lit(None).cast("double")})
    labels = state.where("topic <> -1").groupBy("topic").agg(F.min("topic_label").alias("label"))
    finish(spark, out, state, labels, c)
    out(spark.createDataFrame([("wall_clock_seconds", time.time() - began), ("llm_calls", float(asked.value + turns[0]))], "metric string, value double"), "14_run_metrics")
    return paths


def evaluate_dir(spark: SparkSession, run_dir: str, top: int = 10, min_df: int = 2, read=None) -> DataFrame:
    """Q19 of a run's folder; ``read(name)`` gives a table or None where the folder has none."""
    docs, topics, texts = read("doc_topics"), read("topics"), read("corpus")
    vectors = read("embeddings")
    if vectors is not None:
        docs = docs.join(vectors.select(F.col("doc_id").cast("string").alias("doc_id"), "embedding"), "doc_id", "left")
    terms = F.slice(F.filter(F.transform(F.split(keys.keyword_column(topics), "[;,]"), lambda t: F.trim(t)), lambda t: t != ""), 1, top)
    words = topics.where("topic <> -1").select("topic", F.explode(terms).alias("term"))
    figures = read("figures")
    given = {r["metric"]: r["value"] for r in figures.collect()} if figures is not None else None
    return evaluate.evaluate_run(docs, texts.select("doc_id", "text"), words, read("trends"), read("shift"), given, min_df=min_df)


def report(docs: DataFrame, topics: DataFrame, texts: DataFrame, trends_: DataFrame | None = None, shift: DataFrame | None = None, metrics: DataFrame | None = None, top: int = 20, examples: int = 3, recent: bool = False) -> str:
    """The extended report: figures, balance, sources of assignments, topic cards with their examples, rising and drifting topics, as Markdown.

    Tables are cut to ``top`` rows, as a report is read; examples are joined with their texts
    after that.
    """
    sizes = docs.where("topic <> -1").groupBy("topic").agg(F.count(F.lit(1)).alias("size"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    text = "keywords_display" if "keywords_display" in topics.columns else "keywords"
    cards = sizes.join(topics.select("topic", "label", F.col(text).alias("keywords")), "topic", "left")
    if trends_ is not None:
        cards = cards.join(trends_.select("topic", "mk_trend_rel", "mk_q_rel", "sen_slope_rel", "burst_max", "emerging"), "topic", "left")
    if shift is not None:
        cards = cards.join(shift.select("topic", "drift_robust_score", "drift_mode"), "topic", "left")
    cards = cards.orderBy(F.desc("size"), "topic").limit(top)
    tables = [("Figures", metrics)] if metrics is not None else []
    balance = evaluate.coverage(docs).join(evaluate.topic_entropy(docs).select("entropy", "entropy_norm"), F.lit(True)).join(evaluate.gini(docs), F.lit(True))
    tables.append(("Balance", balance))
    if "assignment_source" in docs.columns:
        tables.append(("Sources of assignments", evaluate.by_source(docs.where("topic <> -1"))))
    if "assignment_confidence" in docs.columns:
        away = F.least(F.greatest(1 - F.col("assignment_confidence"), F.lit(0.0)), F.lit(1.0))
        tables.append(("Uncertainty", docs.where("topic <> -1").agg(F.avg(away).alias("mean"), F.median(away).alias("median"), F.percentile(away, 0.1).alias("p10"), F.percentile(away, 0.9).alias("p90"))))
    tables.append(("Topics", cards))
    if trends_ is not None:
        tables.append(("Emerging topics", trends_.where("emerging").select("topic", "mk_trend_rel", "mk_q_rel", "sen_slope_rel", "burst_max").orderBy("mk_q_rel", F.desc("sen_slope_rel"), "topic").limit(top)))
    if shift is not None:
        tables.append(("Drifting topics", shift.select("topic", "drift_robust_score", "drift_total_dist", "years").orderBy(F.desc("drift_robust_score"), "topic").limit(top)))
    shown = docs.join(cards.select("topic"), "topic", "left_semi")
    some = keys.examples(shown, examples, recent, texts.select("doc_id", F.substring(F.regexp_replace("text", r"[\s|]+", " "), 1, 200).alias("text")))
    tables.append(("Examples", some.select("topic", "rank", "doc_id", "year", "assignment_confidence", "text").orderBy("topic", "rank")))
    return evaluate.render("Topic report", *tables)
