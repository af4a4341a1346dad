import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import centroids as C
from trendloom.operators.clusters import DensityClusters, fit_topics, split_topics
from trendloom.operators.components import connected_components
from trendloom.operators.concepts import label_index
from trendloom.operators.keywords import greedy
from trendloom.plans.views import doc_topics_vec
from trendloom.sources import tables


def test_components_against_union_find(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 5), (7, None)], "u long, v long")
    assert {r["node"]: r["component"] for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_top_two_join_agrees_with_matrix(spark, sf, monkeypatch):
    v = doc_topics_vec(spark, sf)
    cents = C.centroids(v.where("topic <> -1"), ["topic"], 2)
    fast = {r["doc_id"]: r for r in C.top_two(v, cents, ["doc_id"]).collect()}
    monkeypatch.setattr(C, "MATRIX_CELLS", 0)
    for r in C.top_two(v, cents, ["doc_id"]).collect():
        assert r["best_topic"] == fast[r["doc_id"]]["best_topic"] and r["margin"] == pytest.approx(fast[r["doc_id"]]["margin"], abs=1e-9)
    assert C.top_two(v, cents.limit(0), ["doc_id"]).where("best_topic is not null").count() == 0


def test_reassign_keeps_assigned_rows(spark, sf):
    v = doc_topics_vec(spark, sf)
    out = C.reassign(v, 0.05)
    assert out.count() == v.count()
    assert out.where("old_topic <> -1 and topic <> old_topic").count() == 0
    assert out.where("topic = -1").count() < v.where("topic = -1").count()
    one = v.where("topic in (-1, 3)")
    assert C.reassign(one, -1.0).where("similarity_margin <> 1.0").count() == 0


def test_merge_map_against_plain(spark, sf):
    v = doc_topics_vec(spark, sf)
    rows = C.merge_map(v, 10_000, 0.5)
    assert rows == []
    rows = C.merge_map(v, 42, -1.0)
    assert rows == sorted(rows, key=lambda r: r[3]) and all(r[5] == r[3] + r[4] for r in rows)


def _blobs(n=40, seed=0):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(0, 0.05, (n, 4)) + c for c in np.eye(4)[:3]])


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_density_clusters_find_blobs(method):
    x = np.vstack([_blobs(), np.random.default_rng(1).uniform(-3, 3, (10, 4))])
    labels, strength = DensityClusters(10, 5, method).labels(x)
    again, _ = DensityClusters(10, 5, method).labels(x)
    assert (labels == again).all() and ((strength >= 0) & (strength <= 1)).all()
    for k in range(3):
        own = labels[k * 40 : k * 40 + 40]
        assert (own == np.bincount(own[own >= 0]).argmax()).mean() > 0.7
    sizes = np.bincount(labels[labels >= 0])
    assert (sizes >= 10).all() and len(sizes) == 3


def test_fit_and_split_topics(spark):
    x = _blobs()
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "doc_id long, topic int, embedding array<double>")
    got = fit_topics(df.drop("topic"), DensityClusters(10, 5), 3)
    assert got.count() == 120 and got.where("topic <> -1").select("topic").distinct().count() == 3
    part = fit_topics(df.drop("topic"), DensityClusters(5, 3), 3, sample=60)
    assert part.count() == 120
    split = split_topics(df, 60, 0.99, 0.0, DensityClusters(10, 5, "leaf"))
    assert split.count() == 120 and split.select("topic").distinct().count() == 3


def test_greedy_keywords():
    df = {"a": 9, "b": 8, "c": 8, "d": 2}
    pairs = {("a", "b"): 8.0, ("a", "c"): 1.0, ("b", "c"): 1.0, ("a", "d"): 2.0}
    assert greedy(df, df, pairs, 10.0, 3) == ["a", "b", "d"] and greedy({}, {}, {}, 1.0, 3) == []


TURTLE = """@prefix cso: <http://x/schema#> .
<http://x/topics/deep_learning> a cso:Topic ; cso:label "deep learning"@en , "derin"@tr ;
    cso:relatedEquivalent <http://x/topics/deep_nets> .
# a comment
<http://x/topics/ai> <http://www.w3.org/2000/01/rdf-schema#label> "ai"@en .
<http://x/topics/ml> <http://www.w3.org/2000/01/rdf-schema#label> "deep learning"@en .
"""


def test_turtle_and_label_index(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(TURTLE)
    triples = tables.read_turtle(spark, str(tmp_path / "o.ttl"))
    assert triples.count() == 6
    got = {(r["uri"].rsplit("/", 1)[1], r["text"], r["ambiguous"]) for r in label_index(triples).collect()}
    assert got == {("deep_learning", "deep learning", True), ("ml", "deep learning", True), ("deep_learning", "deep nets", False)}


def test_npy_csv_and_artifacts(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "e.npy", x)
    (tmp_path / "e_doc_ids.json").write_text('["a", "b", "c", 4]')
    got = {r["doc_id"]: r["embedding"] for r in tables.read_npy(spark, f"file://{tmp_path}/e.npy").collect()}
    assert got == {"a": [0, 1, 2], "b": [3, 4, 5], "c": [6, 7, 8], "4": [9, 10, 11]}
    (tmp_path / "x.csv").write_bytes('doc_id,t\n1,"café – ""q""\nline"\n'.encode("cp1252"))
    assert tables.read_csv(spark, str(tmp_path / "x.csv")).collect()[0]["t"] == 'café – "q"\nline'
    spark.range(3).write.parquet(str(tmp_path / "run/09_final_doc_topics.parquet"))
    assert tables.read_artifact(spark, str(tmp_path / "run"), "doc_topics").count() == 3
    assert tables.find_run_dir(spark, [str(tmp_path / "no"), str(tmp_path / "run")]) == str(tmp_path / "run")
    with pytest.raises(FileNotFoundError):
        tables.resolve(spark, str(tmp_path), "topics")
    made = tables.cached(spark, str(tmp_path / "cache"), "v1", lambda: spark.range(2))
    assert made.count() == tables.cached(spark, str(tmp_path / "cache"), "v1", lambda: spark.range(9)).count() == 2


def test_top_k_join_agrees_with_matrix(spark, sf, monkeypatch):
    v = doc_topics_vec(spark, sf)
    labels = C.centroids(v.where("topic <> -1"), ["topic"]).select("topic", F.col("centroid").alias("embedding"))
    fast = sorted((r["doc_id"], r["rank"], r["topic"], round(r["sim"], 7)) for r in C.top_k(v, labels, 2).collect())
    monkeypatch.setattr(C, "MATRIX_CELLS", 0)
    ranked = C.top_k(v, labels, 2)
    assert sorted((r["doc_id"], r["rank"], r["topic"], round(r["sim"], 7)) for r in ranked.collect()) == fast
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert C.top_k(v, labels, 0).count() == 0


@pytest.mark.parametrize("cells", [20_000_000, 8, 0])
def test_parts_of_a_matrix_agree_on_nulls_ties_and_repeats(spark, monkeypatch, cells):
    """However many parts the matrix comes in: rows without a vector go, repeated rows stay, ties go to the smaller topic or label."""
    monkeypatch.setattr(C, "MATRIX_CELLS", cells)
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0])], "doc_id int, embedding array<double>")
    cents = spark.createDataFrame([(7, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [1.0, 0.0]), (5, [-1.0, 0.0]), (4, [0.6, 0.8])], "topic int, centroid array<double>")
    got = sorted((r["doc_id"], r["best_topic"], r["best_sim"], r["second_sim"]) for r in C.top_two(docs, cents, ["doc_id"]).collect())
    assert got == [(1, 2, 1.0, 0.8), (1, 7, 1.0, 1.0), (3, 4, 0.989949493661, 0.707106781187), (3, 4, 0.989949493661, 0.707106781187), (4, 5, 1.0, 0.0)]
    labels = cents.select(F.col("topic").alias("name"), F.col("centroid").alias("embedding"))
    ranks = sorted((r["doc_id"], r["rank"], r["name"]) for r in C.top_k(docs, labels, 3).collect())
    assert ranks == sorted([(1, 1, 7), (1, 2, 9), (1, 3, 4), (1, 1, 2), (1, 2, 4), (1, 3, 5), *[(3, 1, 4), (3, 2, 2), (3, 3, 7)] * 2, (4, 1, 5), (4, 2, 2), (4, 3, 4)])
    pairs = sorted((r["a"], r["b"], r["sim"]) for r in C.near_pairs(labels, 0.6, "name").collect())
    assert pairs == [(2, 4, 0.8), (4, 7, 0.6), (4, 9, 0.6), (7, 9, 1.0)]


@pytest.mark.parametrize("cells", [20_000_000, 8])
def test_silhouette_against_pairs(spark, monkeypatch, cells):
    monkeypatch.setattr(C, "MATRIX_CELLS", cells)
    rng = np.random.default_rng(3)
    x, topic = rng.normal(size=(40, 4)), np.r_[np.repeat([0, 1, 2], 13), 5]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    want = []
    for i in range(40):
        own = (topic == topic[i]) & (np.arange(40) != i)
        b = min(d[i][topic == t].mean() for t in set(topic.tolist()) - {topic[i]})
        want.append((b - d[i][own].mean()) / max(b, d[i][own].mean()) if own.any() else 0.0)
    df = spark.createDataFrame([(i, int(t), v.tolist()) for i, (t, v) in enumerate(zip(topic, x, strict=True))] + [(99, -1, [1.0] * 4), (98, 1, None)], "doc_id int, topic int, embedding array<double>")
    got = C.silhouette(df).first()
    assert got["docs"] == 40 and got["silhouette"] == pytest.approx(np.mean(want))
    assert C.silhouette(df.where("topic = 1")).count() == 0


def plain_coherence(docs, words, window):
    """c_npmi and c_v of one topic's words over explicit windows."""
    import math
    import re

    windows = []
    for t in docs:
        ts = re.findall(r"[a-z0-9]+(?:[-_][a-z0-9]+)*", (t or "").lower())
        windows += [set(ts[i : i + window]) for i in range(max(1, len(ts) - window + 1))]
    n = len(windows)
    p = lambda *ws: sum(all(w in s for w in ws) for s in windows) / n

    def score(a, b):
        if a == b:
            return 1.0
        both = p(a, b)
        if both == 0:
            return -1.0
        return math.log((both + 1e-12) / (p(a) * p(b))) / -math.log(both + 1e-12)

    pairs = [score(a, b) for i, a in enumerate(words) for b in words[i + 1 :]]
    vectors = np.array([[score(a, b) for b in words] for a in words])
    total = vectors.sum(0)
    return np.mean(pairs), np.mean([v @ total / (np.linalg.norm(v) * np.linalg.norm(total)) for v in vectors])


@pytest.mark.parametrize("listed", [20_000, 0])
def test_coherence_against_windows(spark, monkeypatch, listed):
    from trendloom.operators import keywords as K

    monkeypatch.setattr(K, "LITERAL_WORDS", listed)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["a-b", "x_1"]
    docs = [" ".join(rng.choice(vocabulary, int(n))) for n in (3, 50, 7, 25, 1, 80)] + ["W1, w2! w1", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id int, text string")
    kws = spark.createDataFrame([(0, "w1"), (0, "w2 a-b"), (0, "x_1"), (1, "w3"), (1, "w4"), (2, "w5"), (3, "nowhere"), (3, "w1")], "topic int, term string")
    got = {r["topic"]: r for r in K.coherence(df, kws, window=6).collect()}
    assert sorted(got) == [0, 1] and got[0]["words"] == 4
    for t, ws in ((0, ["a-b", "w1", "w2", "x_1"]), (1, ["w3", "w4"])):
        npmi, cv = plain_coherence(docs, ws, 6)
        assert got[t]["c_npmi"] == pytest.approx(npmi, abs=1e-6) and got[t]["c_v"] == pytest.approx(cv, abs=1e-6)


def test_ctfidf_by_hand(spark):
    from collections import Counter

    from trendloom.operators import keywords as K

    docs = [(0, "aa bb aa cc"), (0, "aa dd"), (1, "bb bb ee aa"), (1, None), (-1, "zz zz aa"), (2, "ff ff")]
    df = spark.createDataFrame(docs, "topic int, text string")
    per, seen = {}, Counter()
    for t, text in docs:
        if t != -1:
            ws = (text or "").split()
            terms = ws + [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)]
            per.setdefault(t, Counter()).update(terms)
            seen.update(set(terms))
    counted = {(r["topic"], r["term"]): (r["tf"], r["df"]) for r in K.term_counts(df).collect()}
    assert {k: v[0] for k, v in counted.items()} == {(t, w): n for t, c in per.items() for w, n in c.items()}
    assert sum(v[1] for k, v in counted.items() if k[1] == "aa") == seen["aa"] == 3
    got = {(r["topic"], r["term"]): r["score"] for r in K.ctfidf(df, 5, 2).collect()}
    kept = {w for w, n in seen.items() if n >= 2}
    topics = [t for t in per if any(w in kept for w in per[t])]
    for (t, w), score in got.items():
        spread = sum(w in per[u] for u in per)
        share = per[t][w] / sum(n for v, n in per[t].items() if v in kept)
        assert score == pytest.approx(share * (np.log((1 + len(topics)) / (1 + spread)) + 1))
    assert {w for _, w in got} == kept


def test_pushdown_reaches_the_scan(spark, sf):
    from trendloom.plans.catalog import QUERIES

    plan = QUERIES["j8_semi"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,200000.0)" in plan and "o_orderpriority" not in plan
    plan = QUERIES["a1_topic_sizes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "BroadcastHashJoin" in plan


def _unit(x):
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@pytest.mark.parametrize("columns", [7, 50, 8192])
def test_nearest_by_blocks_is_a_stable_sort(monkeypatch, columns):
    monkeypatch.setattr(C, "BLOCK_COLUMNS", columns)
    rng = np.random.default_rng(0)
    for n, k in [(1, 5), (4, 10), (60, 3), (300, 10)]:
        m, x = _unit(rng.normal(size=(n, 8))), _unit(rng.normal(size=(600, 8)))
        m[rng.integers(0, n, n // 2)], x[::7], x[5] = m[0], m[0], 0
        if n == 60:
            m[3], x[9] = np.nan, np.nan
        s = np.round(x @ m.T, 9)
        number = np.argsort(-s, axis=1, kind="stable")[:, :k]
        got = C._nearest(x, m, m.astype(np.float32), k)
        assert np.array_equal(got[0], number) and np.allclose(got[1], np.take_along_axis(s, number, axis=1), equal_nan=True)
        some = C._first_of_equal(m, k)
        assert np.array_equal(some[C._nearest(x, m[some], m[some].astype(np.float32), k)[0]], number) or n == 60


def _most_held(run):
    """MB that one large batch takes in Python, in this process, through a matrix of 60,000 rows."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(60_000, 16))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(list(vectors[:10_000]), pa.list_(pa.float64()))], ["a", "_v"])
    x, m = C._unit_rows(batch.column(1)), _unit(vectors)
    tracemalloc.start()
    run(x, m, m.astype(np.float32))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_memory_of_products_is_bounded():
    """10,000 x 60,000 products were 4800 MB at once."""
    assert _most_held(lambda x, m, m32: C._nearest(x, m, m32, 5)) < 300
    assert _most_held(lambda x, m, m32: [None for _ in C._near(x, m, m32, 0.9, lambda i, j: i < j)]) < 300


@pytest.mark.parametrize("cells", [20_000_000, 400])
def test_near_forest_joins_what_near_pairs_join(spark, monkeypatch, cells):
    monkeypatch.setattr(C, "MATRIX_CELLS", cells)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 6))
    v[100:200] = v[0]
    labels = spark.createDataFrame([(f"n{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "id string, embedding array<double>")
    pairs, forest = C.near_pairs(labels, 0.8), C.near_forest(labels, 0.8)
    edges = {(r["u"], r["v"]) for r in forest.collect()}
    assert edges <= {(r["a"], r["b"]) for r in pairs.collect()} and len(edges) < pairs.count() / 2
    parts = [sorted(map(tuple, connected_components(e).collect())) for e in (forest, pairs.selectExpr("a u", "b v"))]
    assert parts[0] == parts[1] and len(parts[0]) > 150
