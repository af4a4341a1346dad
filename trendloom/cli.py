"""``python -m trendloom.cli COMMAND``: a run, a baseline, or stages on the artifacts of a run's folder."""

from __future__ import annotations

import argparse
import sys
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import centroids, clusters, concepts, evaluate, keys, trends
from trendloom.plans import run as runs
from trendloom.providers.choosers import FirstCandidate, HttpChooser
from trendloom.providers.embedders import embed
from trendloom.session import local
from trendloom.sources import tables


def _floats(text: str) -> list[float]:
    """T21."""
    return [float(x) for x in text.split(",") if x.strip()]


def _config(p: argparse.ArgumentParser) -> None:
    """An option for each field of Config."""
    for f in fields(runs.Config):
        kind = {"int": int, "float": float, "str": str, "bool": lambda v: v.lower() in ("1", "true", "yes", "on")}[f.type.split(" ")[0]]
        p.add_argument(f"--{f.name}", type=kind, default=f.default)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trendloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "bare", "llm", "preprocess", "trends", "stability", "evaluate", "sweep", "report", "compare"):
        c = sub.add_parser(name)
        c.add_argument("--run_dir", required=name != "compare")
        if name in ("run", "bare", "llm", "preprocess"):
            c.add_argument("--data", required=True, help="CSV with titles, abstracts, kinds and years")
            c.add_argument("--max_tr_chars", type=int, default=0)
        if name in ("run", "bare", "llm"):
            _config(c)
        if name == "run":
            c.add_argument("--cso_ttl", help="Turtle file of an ontology")
            c.add_argument("--llm_mode", default="none", choices=["none", "first", "http"])
        if name in ("run", "llm"):
            c.add_argument("--url", default="http://localhost:11434")
            c.add_argument("--model", default="")
        if name == "llm":
            c.add_argument("--max_topics", type=int, default=500)
            c.add_argument("--gen_max_docs", type=int, default=1000)
            c.add_argument("--topic_min_freq", type=int, default=2)
            c.add_argument("--st_sim_threshold", type=float, default=0.85)
            c.add_argument("--doc_chars", type=int, default=1200)
        if name == "trends":
            c.add_argument("--trend_alpha", type=float, default=0.05)
            c.add_argument("--mk_method", default="classic", choices=["classic", "tfpw", "hamed_rao"])
            c.add_argument("--mk_lag_max", type=int, default=10)
            c.add_argument("--prevalence_mode", default="relative", choices=["relative", "absolute"])
            c.add_argument("--trend_min_topic_size", type=int, default=15)
            c.add_argument("--min_year_docs", type=int, default=10)
            c.add_argument("--min_docs_shift", type=int, default=5)
            c.add_argument("--emerging_if_burst", action="store_true")
        if name == "stability":
            c.add_argument("--stability_runs", type=int, default=3)
            c.add_argument("--min_cluster_size", type=int, default=50)
            c.add_argument("--min_samples", type=int, default=10)
            c.add_argument("--sample", type=int, default=clusters.SAMPLE)
            c.add_argument("--seed", type=int, default=42)
        if name in ("evaluate", "compare"):
            c.add_argument("--top_n", type=int, default=10)
            c.add_argument("--min_df", type=int, default=2)
        if name == "sweep":
            c.add_argument("--grid_sim", type=_floats, required=True)
            c.add_argument("--grid_mar", type=_floats, required=True)
            c.add_argument("--min_docs_per_topic", type=int, default=1)
            c.add_argument("--max_outliers", type=int, default=0)
        if name == "report":
            c.add_argument("--top_n", type=int, default=20)
            c.add_argument("--examples", type=int, default=3)
            c.add_argument("--prefer_recent", action="store_true")
        if name == "compare":
            c.add_argument("--runs", nargs="+", required=True, help="label=path")
            c.add_argument("--out_dir", required=True)
    return p


def _doc_topics(spark: SparkSession, run_dir: str) -> DataFrame:
    """The run's document topics, years and kinds filled in from its corpus."""
    df = keys.normalize_columns(tables.read_artifact(spark, run_dir, "doc_topics"))
    if "year" not in df.columns:
        df = keys.backfill(df, _corpus(spark, run_dir), ["year"])
    return df.withColumns({"topic": F.col("topic").cast("int"), "year": F.col("year").cast("int")})


def _corpus(spark: SparkSession, run_dir: str) -> DataFrame:
    return keys.normalize_columns(tables.read_artifact(spark, run_dir, "corpus"))


def _vectors(spark: SparkSession, run_dir: str) -> DataFrame | None:
    """The run's vectors, Parquet before .npy."""
    if tables.exists(spark, f"{run_dir}/embeddings.parquet"):
        return spark.read.parquet(f"{run_dir}/embeddings.parquet")
    return tables.read_npy(spark, f"{run_dir}/embeddings.npy") if tables.exists(spark, f"{run_dir}/embeddings.npy") else None


def _with_vectors(spark: SparkSession, run_dir: str, docs: DataFrame) -> DataFrame:
    """Docs with the run's vectors, or ones made from its texts where there are none."""
    vectors = tables.align_vectors(_corpus(spark, run_dir).select("doc_id", "text"), _vectors(spark, run_dir), embed)
    return docs.join(vectors, "doc_id")


def _metrics(spark: SparkSession, run_dir: str, top: int = 10, min_df: int = 2) -> DataFrame:
    def read(name: str) -> DataFrame | None:
        if name == "doc_topics":
            return _doc_topics(spark, run_dir)
        if name == "embeddings":
            return _vectors(spark, run_dir)
        if name == "figures":
            path = f"{run_dir}/14_run_metrics.parquet"
            return spark.read.parquet(path) if tables.exists(spark, path) else None
        try:
            return keys.normalize_columns(tables.read_artifact(spark, run_dir, name))
        except FileNotFoundError:
            if name in ("topics", "corpus"):
                raise
            return None

    return runs.evaluate_dir(spark, run_dir, top, min_df, read)


def _optional(spark: SparkSession, run_dir: str, name: str) -> DataFrame | None:
    try:
        return tables.read_artifact(spark, run_dir, name)
    except FileNotFoundError:
        return None


def _labels(spark: SparkSession, path: str) -> DataFrame:
    index = concepts.label_index(tables.read_turtle(spark, path))
    return embed(index)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = local()
    out = a.run_dir if a.command != "compare" else a.out_dir
    save = lambda df, name: df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
    if a.command in ("run", "bare", "llm"):
        corpus = keys.preprocess(tables.read_csv(spark, a.data), max_foreign=a.max_tr_chars)
        config = runs.Config(**{f.name: getattr(a, f.name) for f in fields(runs.Config)})
        if a.command == "llm":
            runs.llm_baseline(spark, corpus, out, HttpChooser(a.url, a.model), config, most=a.max_topics, gen_docs=a.gen_max_docs, min_freq=a.topic_min_freq, sim=a.st_sim_threshold, doc_chars=a.doc_chars)
        elif a.command == "bare":
            runs.bare(spark, corpus, out, config)
        else:
            chooser = {"none": None, "first": FirstCandidate(config.llm_floor), "http": HttpChooser(a.url, a.model)}[a.llm_mode]
            runs.run(spark, corpus, out, config, labels=_labels(spark, a.cso_ttl) if a.cso_ttl else None, chooser=chooser)
    elif a.command == "preprocess":
        save(keys.preprocess(tables.read_csv(spark, a.data), max_foreign=a.max_tr_chars), "01_preprocessed_documents")
    elif a.command == "trends":
        docs = _doc_topics(spark, a.run_dir).where("year is not null")
        t = trends.topic_trends(docs, a.trend_alpha, a.trend_min_topic_size, a.min_year_docs, a.mk_method, a.mk_lag_max, a.prevalence_mode)
        if a.emerging_if_burst:
            t = t.withColumn("emerging", F.col("emerging") & (F.col("burst_max") >= 2))
        save(t, "10_topic_trends")
        save(centroids.drift(_with_vectors(spark, a.run_dir, docs), a.min_docs_shift), "11_semantic_shift")
    elif a.command == "stability":
        docs = _with_vectors(spark, a.run_dir, _doc_topics(spark, a.run_dir).select("doc_id"))
        save(clusters.stability(docs, a.stability_runs, a.seed, clusters.DensityClusters(a.min_cluster_size, a.min_samples), a.sample), "13_model_stability")
    elif a.command == "evaluate":
        tables.write_metrics(_metrics(spark, a.run_dir, a.top_n, a.min_df), f"{out}/14_topic_model_evaluation")
    elif a.command == "sweep":
        docs = _with_vectors(spark, a.run_dir, _doc_topics(spark, a.run_dir))
        save(centroids.sweep(docs, a.grid_sim, a.grid_mar, a.min_docs_per_topic, a.max_outliers), "05_sensitivity")
    elif a.command == "report":
        topics = keys.normalize_columns(tables.read_artifact(spark, out, "topics"))
        text = runs.report(_doc_topics(spark, out), topics, _corpus(spark, out), _optional(spark, out, "trends"), _optional(spark, out, "shift"), _metrics(spark, out), a.top_n, a.examples, a.prefer_recent)
        print(text)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/15_report")
    else:
        all_, topics = None, {}
        for item in a.runs:
            label, _, path = item.partition("=")
            one = _metrics(spark, path, a.top_n, a.min_df).select(F.lit(label).alias("label"), F.lit(path).alias("run"), "metric", "value")
            all_ = one if all_ is None else all_.union(one)
            topics.setdefault(label, {})[path] = _doc_topics(spark, path).select("doc_id", "topic")
        summary = evaluate.compare(all_)
        if any(len(t) > 1 for t in topics.values()):
            summary = summary.union(evaluate.compare_agreement(topics))
        save(summary, "17_ablation_summary")
    return 0


if __name__ == "__main__":
    sys.exit(main())
