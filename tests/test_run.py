"""The main run, the baselines and the evaluation from end to end."""

import json
import math
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom import cli
from trendloom.operators import clusters, concepts, evaluate, keywords
from trendloom.operators.keys import examples
from trendloom.plans import run as R
from trendloom.providers.choosers import FirstCandidate, HttpChooser, assign_labels, discover, refine_taxonomy
from trendloom.sources import tables


@pytest.fixture(scope="module")
def corpus(spark):
    """Three themes over twelve years, the first of them rising, and a few documents of no theme."""
    rng = np.random.default_rng(7)
    themes = [[f"{t}{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(4)] for t in ("neur", "soil", "tax")]
    rows = []
    for year in range(2000, 2012):
        for t, n in ((0, 2 + year - 2000), (1, 8), (2, 6)):
            for _ in range(n):
                rows.append((f"d{len(rows)}", year, " ".join(rng.choice(themes[t], 30)), "doctoral" if len(rows) % 3 else "master"))
        rows.append((f"d{len(rows)}", year, " ".join(rng.choice(sum(themes, []), 30)), "master"))
    rows.append((None, 2001, "no id", None))
    rows.append(("d0", 2001, None, None))
    return spark.createDataFrame(rows, "doc_id string, year int, text string, thesis_type string")


CONFIG = dict(min_cluster_size=10, min_samples=3, min_df=2, reassign_sim=0.3, augment_min_cluster_size=4, split_min_size=60, trend_min_topic_size=10, min_year_docs=5, min_docs_shift=2, stability_runs=2, merge_micro=True, merge_sim=0.5)


@pytest.fixture(scope="module")
def done(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    labels = spark.createDataFrame([("u1", "neuraa neurbb", False), ("u2", "soilaa soilbb", False)], "uri string, text string, ambiguous boolean")
    from trendloom.providers.embedders import embed

    c = R.Config(**CONFIG, gate_sim=0.9, gate_entropy_quantile=0.3, concept_sim=0.05, llm_floor=0.1)
    return path, R.run(spark, corpus, path, c, labels=embed(labels), chooser=FirstCandidate(0.1))


def test_run_finds_the_themes(spark, corpus, done):
    path, paths = done
    final = spark.read.parquet(paths["09_final_doc_topics"])
    assert final.count() == corpus.where("doc_id is not null").count() and final.select("doc_id").distinct().count() == final.count()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(paths["01_preprocessed_documents"]).collect()}
    own = {}
    for r in final.where("topic <> -1").collect():
        words = re.findall(r"[a-z]+", text[r["doc_id"]])
        if words:
            own.setdefault(r["topic"], []).append(max(("neur", "soil", "tax"), key=lambda t: sum(w.startswith(t) for w in words)))
    assert len(own) >= 3 and all(max(v.count(x) for x in set(v)) / len(v) > 0.8 for v in own.values())
    topics = {r["topic"]: r for r in spark.read.parquet(paths["09_final_topics"]).collect()}
    assert set(topics) == set(own) and all(t["keywords"] and t["label"] for t in topics.values())
    rising = {max(set(v), key=v.count): t for t, v in own.items() if len(v) > 60}
    trend = {r["topic"]: r for r in spark.read.parquet(paths["10_topic_trends"]).collect()}
    assert trend[rising["neur"]]["mk_trend_abs"] == "increasing"
    assert set(spark.read.parquet(paths["11_semantic_shift"]).columns) >= {"topic", "label", "years", "drift_mode", "missing_emb_rate", "drift_total_dist_raw"}
    figures = {r["metric"]: r["value"] for r in spark.read.parquet(paths["14_run_metrics"]).collect()}
    assert figures["wall_clock_seconds"] > 0 and figures["llm_calls"] >= 0
    for name in ("02_cso_concepts", "06_reassigned_doc_topics", "07_llm_gated_doc_topics", "08_augmented_doc_topics", "08_split_doc_topics", "08_micro_merge_map", "08b_final_cleanup_doc_topics", "12_cso_concept_trends", "13_prevalence_baseline", "13_model_stability"):
        assert Path(paths[name]).exists()
    sources = {r[0] for r in final.select("assignment_source").distinct().collect()}
    assert sources <= {"model", "centroid", "llm", "augment", "outlier"} and final.where("topic = -1 and assignment_source <> 'outlier'").count() == 0


def test_evaluation_report_and_comparison(spark, done, tmp_path, capsys):
    path, _ = done
    assert cli.main(["evaluate", "--run_dir", path, "--min_df", "1"]) == 0
    part = next(Path(path, "14_topic_model_evaluation").glob("part-*"))
    got = {r["metric"]: r["value"] for r in map(json.loads, part.read_text().splitlines()) if "metric" in r} or json.loads(part.read_text().splitlines()[0])
    assert set(evaluate.METRICS) <= set(got) or len(got) >= 14
    assert cli.main(["report", "--run_dir", path, "--top_n", "3", "--examples", "2", "--prefer_recent"]) == 0
    said = capsys.readouterr().out
    for part in ("## Figures", "## Balance", "## Sources of assignments", "## Uncertainty", "## Topics", "## Examples", "## Drifting topics"):
        assert part in said
    assert cli.main(["compare", "--runs", f"a={path}", f"a={path}/", "--out_dir", str(tmp_path)]) == 0
    summary = {(r["label"], r["metric"]): r for r in spark.read.parquet(str(tmp_path / "17_ablation_summary.parquet")).collect()}
    assert summary["a", "ami_all"]["mean"] == pytest.approx(1.0) and summary["a", "docs"]["n_runs"] == 2 and summary["a", "docs"]["std"] == 0
    assert cli.main(["trends", "--run_dir", path, "--min_year_docs", "5", "--trend_min_topic_size", "10"]) == 0
    assert cli.main(["sweep", "--run_dir", path, "--grid_sim", "0.1,0.9", "--grid_mar", "0"]) == 0
    assert cli.main(["stability", "--run_dir", path, "--stability_runs", "2", "--min_cluster_size", "10", "--min_samples", "3"]) == 0


def test_commands_from_a_csv(spark, tmp_path):
    lines = ["english_title,abstract_en,thesis_type,year"]
    rng = np.random.default_rng(1)
    for i in range(120):
        words = " ".join(f"{'ab'[i % 2]}word{j}" for j in rng.integers(0, 12, 25))
        lines.append(f'"Title {i}","{words}, with ""quotes""",doctoral,{2000 + i % 6}')
    (tmp_path / "c.csv").write_text("\n".join(lines))
    args = ["bare", "--data", str(tmp_path / "c.csv"), "--run_dir", str(tmp_path / "bare"), "--min_cluster_size", "10", "--min_samples", "3", "--min_df", "2", "--trend_min_topic_size", "5", "--min_year_docs", "5", "--min_docs_shift", "2"]
    assert cli.main(args) == 0
    final = spark.read.parquet(str(tmp_path / "bare" / "09_final_doc_topics.parquet"))
    assert final.count() == 120 and final.where("topic <> -1").select("topic").distinct().count() >= 2


class Namer:
    """A model that names topics by the first letters of words, and assigns by them."""

    def reply(self, prompts):
        out = []
        for p in prompts:
            if p.startswith("Known topics"):
                docs = [x.split(". ", 1)[1] for x in p.split("Documents:\n")[1].split("\n")]
                names = [d.split()[0][:4] for d in docs]
                out.append(json.dumps({"topics": [{"label": n, "keywords": ["x"]} for n in dict.fromkeys(names)], "assignments": names}))
            else:
                doc = p.split("\nDocument: ", 1)[1]
                out.append(json.dumps({"label": doc.split()[0][:4] if doc.split() else "Outlier", "quote": doc[:9].strip()}))
        return out


def test_llm_baseline(spark, corpus, tmp_path):
    paths = R.llm_baseline(spark, corpus, str(tmp_path / "llm"), Namer(), R.Config(min_df=2, min_year_docs=5, trend_min_topic_size=10, min_docs_shift=2), gen_docs=60, min_freq=1, sim=0.99)
    final = spark.read.parquet(paths["09_final_doc_topics"])
    assert final.count() == corpus.where("doc_id is not null").count() and final.where("topic <> -1").select("topic").distinct().count() >= 3
    figures = {r["metric"]: r["value"] for r in spark.read.parquet(paths["14_run_metrics"]).collect()}
    assert figures["llm_calls"] > 200


def test_discovery_counts_and_stops():
    said = []

    def one(prompt):
        said.append(prompt)
        return json.dumps({"topics": ["A", {"name": "B", "keywords": ["k"]}, {}], "assignments": ["a"] * (prompt.count("\n") - 1)})

    found = discover(iter(["t"] * 100), one, 5, 10, 50)
    assert [t["label"] for t in found] == ["A", "B"] and found[0]["gen_freq"] == 15 and len(said) == 3
    assert discover(iter([]), one) == []


def test_taxonomy_groups_by_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(3, 8)) for _ in range(1)])
    x = np.repeat(x, 4, axis=0) + 0.05 * rng.normal(size=(12, 8))
    rows = [(i, f"t{i}", i % 5, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label string, gen_freq long, embedding array<double>")
    got = {(r["label"], r["gen_freq"], r["members"]) for r in refine_taxonomy(df, 2, 0.9).collect()}
    want = set()
    for g in range(3):
        own = [(f, name) for i, name, f, _ in rows if i // 4 == g and f >= 2]
        want.add((min(own, key=lambda t: (-t[0], t[1]))[1], sum(f for f, _ in own), len(own)))
    assert got == want


def test_assign_labels_retries_what_is_open(spark):
    class Learns:
        def reply(self, prompts):
            return [json.dumps({"label": "Good" if "is not" in p else "odd", "quote": "zz"}) if "hard" in p else json.dumps({"label": "good", "quote": "easy"}) for p in prompts]

    df = spark.createDataFrame([(1, "easy text"), (2, "hard   zz text"), (3, None), (4, "easy" + "x" * 50)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in assign_labels(df, ["Good"], Learns(), 2, doc_chars=3).collect()}
    assert got[1] == ("Outlier", "easy", "failed", 2)  # the quote isn't in the three characters shown
    got = {r["doc_id"]: tuple(r)[1:] for r in assign_labels(df, ["Good"], Learns(), 2, doc_chars=0, taxonomy="- Good: is (x)").collect()}
    assert got[1] == ("Good", "easy", "ok", 0) and got[2] == ("Good", "zz", "ok", 1) and got[3][2] == "failed"


def test_http_chooser_falls_back():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = body["prompt"] if "prompt" in body else body["messages"][0]["content"]
            ok = self.path == "/api/chat" and "chat" in text or self.path == "/api/generate" and "generate" in text
            data = json.dumps({"message": {"content": "said"}, "response": "made"}).encode() if ok else b"{}"
            self.send_response(200 if ok else 500)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = HttpChooser(f"http://127.0.0.1:{server.server_port}", "m", 5).reply(["chat", "generate", "neither"])
    server.shutdown()
    assert got[:2] == ["said", "made"] and got[2] not in ("said", "made")


def test_sampled_topics_find_what_a_whole_clustering_finds(spark):
    """Beyond the sample's size, rounds over what is left find the same dense groups; each side of the size gives every row one answer."""
    rng = np.random.default_rng(2)
    sizes = [300, 200, 60]
    x = np.vstack([rng.normal(0, 0.02, (n, 4)) + c for n, c in zip(sizes, np.eye(4), strict=False)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    truth = np.repeat([0, 1, 2], sizes)
    for sample in (1000, 560, 150):
        got = {r["doc_id"]: r for r in clusters.fit_topics(df, clusters.DensityClusters(8, 3), 3, sample).collect()}
        assert len(got) == 560
        topic = np.array([got[i]["topic"] for i in range(560)])
        for g in range(3):
            own = topic[(truth == g) & (topic >= 0)]
            assert len(own) > 0.7 * sizes[g] and not set(own) & set(topic[(truth != g) & (topic >= 0)])
        counted = [int((topic == t).sum()) for t in range(topic.max() + 1)]
        assert counted == sorted(counted, reverse=True) and all(0 <= got[i]["probability"] <= 1 for i in got)


def test_augment_names_then_clusters(spark):
    """Of four groups, the first has a topic, the second a label, and the other two only lie apart."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(80):
        g = i % 4
        v = (np.eye(6)[g] + 0.02 * rng.normal(size=6)).tolist()
        rows.append((i, 0 if g == 0 else -1, f"word{g} thing{g} part{g}", v, "named label" if g == 1 else "", 0.9 if g == 1 else 0.0, 0.1))
    df = spark.createDataFrame(rows, "doc_id long, topic int, text string, embedding array<double>, cso_top1_label string, cso_top1_sim double, entropy double")
    out = {r["doc_id"]: r["topic"] for r in clusters.augment(df, 5, 2).collect()}
    assert {out[i] for i in range(0, 80, 4)} == {0} and {out[i] for i in range(1, 80, 4)} == {1}
    groups = [{out[i] for i in range(g, 80, 4)} - {-1} for g in (2, 3)]
    assert all(len(g) >= 1 and min(g) >= 2 for g in groups) and not groups[0] & groups[1]
    assert sum(out[i] >= 2 for i in range(80) if i % 4 >= 2) >= 20
    table = {r["label"]: r for r in concepts.symbolic_topics(df, 5)[1].collect()}
    assert table["named label"]["topic"] == 1 and table["named label"]["size"] == 20 and not table["named label"]["merged"]
    merged = concepts.symbolic_topics(df.withColumn("embedding", F.array(*[F.lit(1.0)] * 6)), 5)[1].first()
    assert merged["merged"] and merged["topic"] == 0


def test_refine_counts_by_hand(spark):
    docs = [(0, "alpha beta gamma"), (0, "alpha beta"), (0, "alpha beta delta"), (0, "alpha gamma"), (1, "omega psi"), (1, "omega psi chi"), (1, "omega")]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(docs)], "doc_id long, topic int, text string")
    topics = spark.createDataFrame([(0, "alpha beta; gamma"), (1, "omega; psi")], "topic int, keywords string")
    got = {r["topic"]: r for r in keywords.refine(df, topics, 3, 10, 2).collect()}
    assert got[0]["keywords_core"].split("; ")[0] == "alpha" and set(got[0]["keywords_core"].split("; ")) == {"alpha", "beta", "gamma"}
    assert got[1]["keywords_core"] == "omega; psi" and "alpha beta" in got[0]["keywords_display"]


def test_agreement_against_cells(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(-1, 4, 200), rng.integers(-1, 3, 200)
    df = lambda x: spark.createDataFrame([(i, int(t)) for i, t in enumerate(x)], "doc_id long, topic int")
    got = evaluate.agreement({"x": df(a), "y": df(b)}).first()
    cells = lambda m: [(i, j, int(((a == i) & (b == j) & m).sum())) for i in range(-1, 4) for j in range(-1, 3) if ((a == i) & (b == j) & m).any()]
    assert got["ami_all"] == pytest.approx(evaluate.ami(cells(np.ones(200, dtype=bool)))) and got["ami_both"] == pytest.approx(evaluate.ami(cells((a >= 0) & (b >= 0))))


@pytest.mark.parametrize(("a", "b", "n"), [([3, 4], [5, 2], 7), ([1, 1, 6], [2, 6], 8), ([50, 50], [30, 70], 100), ([10], [10], 10)])
def test_expected_mi_is_the_sum_over_overlaps(a, b, n):
    want = 0.0
    for i in a:
        for j in b:
            for k in range(max(1, i + j - n), min(i, j) + 1):
                want += k / n * math.log(n * k / (i * j)) * math.comb(i, k) * math.comb(n - i, j - k) / math.comb(n, j)
    assert evaluate.expected_mi(a, b, n) == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_expected_mi_of_large_tables_is_quick():
    import time

    began = time.perf_counter()
    big = evaluate.expected_mi([400_000_000, 600_000_000], [500_000_000, 500_000_000], 1_000_000_000)
    assert 0 < big < 1e-8 and time.perf_counter() - began < 5


def test_examples_with_texts_and_writers(spark, tmp_path):
    docs = spark.createDataFrame([("a", 1, 2000, 0.5), ("b", 1, 2001, 0.9), ("c", -1, 2001, 0.9)], "doc_id string, topic int, year int, assignment_confidence double")
    texts = spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string")
    assert [(r["doc_id"], r["text"]) for r in examples(docs, 1, texts=texts).collect()] == [("b", "y")]
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "doc_id string, embedding array<double>")
    tables.write_vectors(vectors, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    encoded = lambda d: d.withColumn("embedding", F.array(F.lit(9.0), F.lit(9.0)))
    assert {r["doc_id"]: list(r["embedding"]) for r in tables.align_vectors(texts, back, encoded).collect()} == {"a": [1.0, 2.0], "b": [9.0, 9.0]}
    index = vectors.select(F.lit("u").alias("uri"), F.lit("t").alias("text"), F.lit(False).alias("ambiguous"), "embedding")
    tables.write_label_index(index, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 1
