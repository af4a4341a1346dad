"""Each query against its SQL in DuckDB; queries without SQL have to run and keep their columns."""

import os

import duckdb
import pytest

from trendloom.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(r[i]) for i in order) for r in data])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_nfkc_query_by_python(spark, sf):
    """Normalised, dashes made hyphens, blanks squeezed, whole texts."""
    import hashlib
    import re
    import unicodedata

    from trendloom.functions.vocabulary import DASHES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["p5_nfkc"](spark, sf).collect():
        t = unicodedata.normalize("NFKC", texts[r["doc_id"]]).translate({ord(c): "-" for c in DASHES})
        assert r["h"] == hashlib.md5(re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ").encode()).hexdigest()


def test_embeddings_query_by_python(spark, sf):
    """Every component of every vector is the embedder's own."""
    import hashlib

    import numpy as np

    from trendloom.providers.embedders import HashedProjection

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    coder = HashedProjection()
    for r in QUERIES["m1_embed"](spark, sf).collect():
        v = coder.encode([texts[r["doc_id"]]])[0].astype(float)
        rounded = [int(np.sign(x) * np.floor(abs(x * 1e6) + 0.5)) for x in v]
        assert r["h"] == hashlib.md5(",".join(map(str, rounded)).encode()).hexdigest()


def test_merges_query_by_python(spark, sf):
    """Small topics go to the nearest larger one in order of size; centroids move as they do."""
    import numpy as np

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in rows}
    topic = {r["vec_id"]: -1 if r["vec_id"] % 5 == 0 else r["label"] for r in rows}
    names = sorted(set(topic.values()) - {-1})
    size = {t: sum(v == t for v in topic.values()) for t in names}
    unit = lambda v: v / np.linalg.norm(v)
    cent = {t: unit(np.mean([x[i] for i in x if topic[i] == t], axis=0)) for t in names}
    want = []
    for t in sorted((t for t in names if size[t] < 45), key=lambda t: (size[t], t)):
        big = [b for b in names if size.get(b, 0) >= 45 and b != t]
        if not big:
            break
        best = max(big, key=lambda b: (round(float(cent[b] @ cent[t]), 9), -b))
        if cent[best] @ cent[t] >= 0:
            want.append((t, best, size[t], size[best]))
            cent[best] = unit(cent[best] * size[best] + cent[t] * size[t])
            size[best] += size.pop(t)
    assert [(r["from_topic"], r["to_topic"], r["from_size"], r["to_size_before"]) for r in QUERIES["m13_merge_micro"](spark, sf).collect()] == want
