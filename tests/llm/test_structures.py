"""SimHash, mixing, WARC, neighbours, media and the pipeline against brute force."""

import gzip
import hashlib
import os
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import clashing, odd_documents, rows_of
from trendloom.llm import byte_bpe, language_id, media, mixing, neighbours, shingles, simhash, toxicity, warc
from trendloom.llm.queries import ORACLES, QUERIES
from trendloom.plans.scratch import Scratch


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    x = np.array(fps, dtype=np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= radius) + i + 1:
            parent[find(int(j))] = find(i)
    low = {}
    for k, i in enumerate(ids):
        r = find(k)
        low[r] = min((v for v in (low.get(r), i) if v is not None), default=None)
    return [low[find(k)] for k in range(len(ids))]


def plain_near(ids, texts):
    """Smallest id reachable by fingerprints within three bits or five-word shingles of Jaccard similarity 0.8, over all pairs."""
    label = plain_components(ids, [plain_fingerprint(t) for t in texts])
    words = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_simhash_odd_rows(spark):
    docs = odd_documents(spark)
    got = simhash.near_components(docs)
    rows = docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = sorted(str((r["doc_id"], f"{f:016x}", c)) for r, f, c in zip(rows, fps, plain_components([r["doc_id"] for r in rows], fps), strict=True))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert rows_of(got) == rows_of(simhash.near_components(clashing(docs)))
    assert simhash.near_components(docs.limit(0)).count() == 0
    kept = simhash.keep_one(clashing(docs))
    assert kept.columns == clashing(docs).columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == sorted([0, *{c for r, c in zip(rows, plain_components([r["doc_id"] for r in rows], fps), strict=True) if c is not None}])


def test_simhash_query(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows[:300]]
    assert fps == [simhash.fingerprint(r["text"]) for r in rows[:300]]
    fps = [simhash.fingerprint(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r["doc_id"] for r in rows], fps), strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op7_simhash"](spark, d).collect()} == want


@pytest.mark.parametrize("chunk", [2048, 16])
def test_bit_sliced_links_on_hot_buckets(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        x = int(c)
        for _ in range(60):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
            x = int(c) if rng.random() < 0.5 else x
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "id long")
    links = simhash.near_links(df).collect()
    parent = {int(np.uint64(f).view(np.int64)): int(np.uint64(f).view(np.int64)) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[find(r["u"])] = find(r["v"])
    want = plain_components(fps, fps)
    ours = {}
    for f, w in zip(fps, want, strict=True):
        assert ours.setdefault(find(int(np.uint64(f).view(np.int64))), w) == w
    assert len(ours) == len(set(want))


def test_targets_and_budgets():
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, None: 0}) == {"a": 0.0, None: 0.0}
    t = mixing.targets({"a": 100, "b": 100, "é": 100, None: 100})
    assert t == pytest.approx({"a": 200.0, "b": 200 * 2 / 3, "é": 200 / 3, None: 200.0})
    rng = random.Random(0)
    for _ in range(60):
        lengths = sorted(rng.sample(range(0, 40), rng.randint(1, 8)))
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)))
        sums = {0}
        for a, b in zip(lengths, counts, strict=True):
            sums = {s + a * k for s in sums for k in range(b + 1)}
        best = max(s for s in sums if s <= budget)
        take = mixing.subset_sum(lengths, counts, budget)
        assert sum(a * b for a, b in zip(take, lengths, strict=True)) == best and all(0 <= a <= b for a, b in zip(take, counts, strict=True))
        got = mixing.fit_budget(np.array(lengths), np.array(counts), budget)
        assert sum(got * np.array(lengths)) <= budget and (got <= counts).all()


def test_budgets_beyond_one_knapsack(monkeypatch):
    """Few long documents are fitted exactly; with little room for bit sets the sum is short by less than one document."""
    fit = lambda lengths, counts, budget: int((mixing.fit_budget(np.array(lengths), np.array(counts), budget) * np.array(lengths)).sum())
    assert fit([70_000, 140_000], [1, 1], 140_000) == 140_000
    assert fit([100_000, 150_000, 70_001], [3, 2, 1], 370_001) == 370_001
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 200_000, 400))
    counts = rng.integers(1, 9, len(lengths))
    budget = int((lengths * counts).sum() // 3)
    assert 0 <= budget - fit(lengths, counts, budget) < lengths.min()
    monkeypatch.setattr(mixing, "BITS", 1 << 14)
    assert 0 <= budget - fit(lengths, counts, budget) < lengths.max()


def test_aims_of_many_sources(spark):
    """The distributed level is that of the plain one, with null sources, empty sources and code points beyond 16 bits."""
    rng = random.Random(3)
    sizes = {f"d{i}" if i % 3 else chr(0xE000 + i) if i % 2 else chr(0x10000 + i): rng.choice((0, 1, 5, 1000, 10**9)) for i in range(500)} | {None: 77, "": 3}
    df = spark.createDataFrame([("n" if k is None else "s" + k, s) for k, s in sizes.items()], "k string, s long")
    got = {None if r["k"] == "n" else r["k"][1:]: r["t"] for r in mixing.aims(df.repartition(7), Scratch(spark, "aims")).collect()}
    assert got == pytest.approx(mixing.targets(sizes))


def test_mix_of_repeated_rows(spark):
    """Rows that repeat id and text are taken as often as the plan says, and no other column decides."""
    rows = [(i % 7, "a b c", "x") for i in range(70)] + [(100 + i, "w " * 4, "y") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    want = mixing.targets({"x": 210, "y": 36})
    for ids, s, n in ((range(7), "x", 3), (range(100, 109), "y", 4)):
        taken = sum(r["taken"] for r in got if r["doc_id"] in ids)
        assert 0 <= want[s] - taken < n and all(r["taken"] in (0, n, 2 * n) for r in got if r["doc_id"] in ids)
    assert mixing.mixed(docs).count() == sum(r["taken"] // r["size"] for r in got)


def test_mixing_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op8_mixing"](spark, d).collect()
    assert sorted(map(str, got)) == rows_of(QUERIES["op8_mixing"](spark, d)) and len(got) == len(docs)
    sums, taken = {}, {}
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        sums[s] = sums.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    want = mixing.targets(sums)
    for r in got:
        s = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sums[s] and r["target"] == pytest.approx(want[s])
    assert all(abs(taken[s] - want[s]) <= 2 for s in sums)


def test_mixing_odd_rows(spark):
    docs = odd_documents(spark)
    got = mixing.mix(docs)
    assert got.count() == docs.count() and mixing.mix(docs.limit(0)).count() == 0
    assert rows_of(got) == rows_of(mixing.mix(clashing(docs).repartition(4)))
    assert mixing.mixed(clashing(docs)).columns == clashing(docs).columns
    words = sum(r["taken"] for r in got.collect())
    assert sum(len((r["text"] or "").split()) for r in mixing.mixed(docs).collect()) == words


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc(spark, tmp_path, compression):
    big, small = "<p>" + "é" * 200, "<p>x"
    pages = [(5, "http://a/\r\nX: 1", big), (2, "http://b", big), (9, None, big), (1, "u", small), (3, "u", small), (4, "u", None), (6, "u", ""), (None, "u", big), (2, "http://b", big), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9)]
    df = clashing(spark.createDataFrame(pages, "page_id long, url string, html string"))
    path = f"file://{tmp_path}/w"
    warc.archive(df, path, Scratch(spark, "t"), compression)
    got = sorted(map(tuple, warc.read_back(spark, path).collect()), key=str)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        first = min((p[0] for p in pages if p[2] == html and p[0] is not None), default=None)
        again = len(data) >= 100 and i != first and sum(p[2] == html for p in pages) > 1
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    name = next(p for p in os.listdir(tmp_path / "w") if p.endswith((".warc", ".warc.gz")))
    raw = (tmp_path / "w" / name).read_bytes()
    assert (gzip.decompress(raw) if compression == "gzip" else raw).startswith(b"WARC/1.1\r\n")
    read = spark.read.format("warc").option("path", path).load()
    plan = read.where("record_type = 'revisit'")
    assert plan.count() == sum(w[3] == "revisit" for w in want) and plan.where("payload is not null").count() == 0
    assert spark.read.format("warc").option("path", path).option("payload", "false").load().where("payload is not null").count() == 0
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_appends_and_foreign_records(spark, tmp_path):
    """Two writes to a folder keep each other's files; a record without an id doesn't pass a filter for one; codings are undone."""
    path = f"file://{tmp_path}/w"
    for i in (1, 2):
        warc.archive(spark.createDataFrame([(i, "u", f"<p>{i}")], "page_id long, url string, html string"), path, Scratch(spark, "t"))
    assert sorted(r["page_id"] for r in warc.read_back(spark, path).collect()) == [1, 2]
    body = gzip.compress(b"hello world")
    chunked = b"5\r\n" + body[:5] + b"\r\n" + f"{len(body) - 5:x}".encode() + b";x=1\r\n" + body[5:] + b"\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(block)
    os.makedirs(tmp_path / "f")
    (tmp_path / "f" / "x.warc").write_bytes(head + block + b"\r\n\r\n")
    read = spark.read.format("warc").option("path", f"file://{tmp_path}/f").load()
    assert [bytes(r["payload"]) for r in read.collect()] == [b"hello world"] and read.where("record_id is not null").count() == 0
    assert read.where("record_type = 'response'").count() == 1


@pytest.mark.parametrize("chunk", [2048, 16])
def test_five_word_near_duplicates_against_all_pairs(spark, monkeypatch, chunk):
    """A large group of near copies, texts that share a passage, and chains whose ends aren't alike."""
    monkeypatch.setattr(shingles, "CHUNK", chunk)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, passage = [word() for _ in range(90)], [word() for _ in range(40)]
    texts = []
    for _ in range(120):
        t = base[:]
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    texts += [[*(word() for _ in range(rng.randint(5, 30))), *passage, *(word() for _ in range(rng.randint(0, 20)))] for _ in range(120)]
    chain = [word() for _ in range(100)]
    for k in range(30):
        chain = [*chain[2:], word(), word()] if k % 2 else [*chain[1:], word()]
        texts.append(chain)
    texts += [[word() for _ in range(3)] for _ in range(5)] + [texts[-1], []]
    docs = spark.createDataFrame([(i, " ".join(t), "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    want = plain_near(list(range(len(texts))), [" ".join(t) for t in texts])
    kept = {r["doc_id"] for r in simhash.keep_one(docs, shingles.similar_components).select("doc_id").collect()}
    assert kept == set(want) and 100 < len(kept) < len(texts) - 100


@pytest.mark.parametrize(("chunk", "size"), [(2048, 16 << 20), (16, 16 << 20), (2048, 20_000)])
def test_pairs_of_near_copies_stay_in_their_tasks(spark, monkeypatch, chunk, size):
    """Eight groups, similar by 0.89 inside and 0.79 across: every two texts are candidates, but tables of pairs stay a few times as long as that of texts."""
    monkeypatch.setattr(shingles, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "CHUNK_BYTES", size, raising=False)
    base = [f"w{i}" for i in range(90)]
    texts = [[*base[: 5 + 10 * (i % 8)], f"other{i}", *base[6 + 10 * (i % 8) :]] for i in range(120)]
    sets = [{tuple(t[i : i + 5]) for i in range(86)} for t in texts]
    assert all((len(a & b) >= 0.8 * len(a | b)) == (i % 8 == j % 8) for i, a in enumerate(sets) for j, b in enumerate(sets))
    saved, save = [], Scratch.save

    def counting(self, df, name="t"):
        out = save(self, df, name)
        saved.extend([out.count()] if set(out.columns) == {"u", "v"} else [])
        return out

    monkeypatch.setattr(Scratch, "save", counting)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = shingles.similar_components(docs, docs.selectExpr("doc_id", "doc_id component_id"), Scratch(spark, "test"), rounds=1)
    assert {r["node"]: r["component"] for r in got.collect()} == {i: i % 8 for i in range(120)}
    assert max(saved) <= 4 * len(texts)


def test_keep_one_of_differing_rows(spark):
    rows = [(1, "a b c d e f g h", "x"), (1, "quite another text than the first one is", "y"), (1, "a b c d e f g h", "w"), (2, "a b c d e f g h", "x"), (3, None, "x"), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = simhash.keep_one(docs)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == [(1, "a b c d e f g h"), (1, "quite another text than the first one is"), (3, None)]
    assert rows_of(got) == rows_of(simhash.keep_one(docs.orderBy(F.desc("source")).repartition(3)))


def test_warc_pushes_filters_down():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    r = warc.WarcReader({"path": "x"})
    left = list(r.pushFilters([EqualTo(("record_type",), "response"), In(("target_uri",), ("a", "b")), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and r.wanted == [("record_type", frozenset(["response"])), ("target_uri", frozenset(["a", "b"]))]

    class Counting(warc._Stream):
        read_bytes = 0

        def read(self, n):
            type(self).read_bytes += n
            return super().read(n)

    import io

    row = {"record_id": "1", "record_type": "resource", "target_uri": "a", "date": "d", "content_type": "text/plain", "refers_to": None, "payload_digest": None, "payload_bytes": None, "payload": b"y" * 999}
    data = warc.record_bytes(row) * 3
    assert list(warc.read_records(Counting(io.BufferedReader(io.BytesIO(data)), False), r.wanted, True)) == [] and Counting.read_bytes == 0


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS", 300)
    monkeypatch.setattr(neighbours, "QUERIES", 5)
    monkeypatch.setattr(neighbours, "RERANK", 32)
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(500, 8)), rng.normal(size=(1, 8)) + 0.01 * rng.normal(size=(500, 8))]).astype(np.float32)
    x[900:950] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [float("nan")] * 8), (5003, [1.0] * 7 + [float("inf")]), (5004, [None] + [1.0] * 7), (5100, [1.0] * 3), (None, [1.0] * 8), (100, x[100].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(clashing(df)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 1000, 100))
    d = x.astype(float)
    for q, found in got.items():
        dist = np.sqrt(np.cumsum((d - d[q]) ** 2, axis=1)[:, -1])
        want = sorted((s, i) for i, s in enumerate(dist.tolist()) if i != q)[:10]
        assert sorted(found) == [(k + 1, i, s) for k, (s, i) in enumerate(want)]
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.where("vec_id in (0, 1, 2)")).count() == 2


@pytest.mark.parametrize(("spread", "share"), [(0.05, 0.2), (1.0, 1.0)])
def test_neighbours_rerank_few_rows_of_clusters(spark, monkeypatch, spread, share):
    """Where vectors cluster, the bound leaves out most rows, and the first cells alone already find nine in ten."""
    monkeypatch.setattr(neighbours, "RERANK", 300)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 16)), 100, axis=0) + spread * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index, coded, _ = neighbours.build(df.select("vec_id", F.col("embedding").alias("v")), Scratch(spark, "share"))
    assert index.rows.sum() == len(x) and coded.count() == len(x)
    want, visited = {}, 0
    for q in range(0, 4000, 100):
        dist = np.sqrt(((x - x[q]) ** 2).sum(1))
        dist[q] = np.inf
        want[q] = set(np.argsort(dist)[:10].tolist())
        a, b = (m[0] for m in index.distances(x[q : q + 1]))
        cells = set(index.nearest_cells(a, b, 300)) | set(index.cells_within(a, b, np.sort(dist)[9], index.scale()))
        visited += index.rows[sorted(cells)].sum()
    assert visited / (40 * len(x)) <= share
    for exact, recall in ((True, 1.0), (False, 0.9 if spread < 1 else 0.1)):
        got = neighbours.search(df, exact=exact).collect()
        assert sum(r["vec_id"] in want[r["query_id"]] for r in got) >= recall * 400


def test_neighbours_of_repeated_rows(spark):
    """Equal vectors under many ids, and one id with two vectors, against brute force over distinct rows."""
    rng = np.random.default_rng(2)
    x = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(300 + i, rng.normal(size=4).tolist()) for i in range(200)] + [(300, [1.0, 2.0, 3.0, 4.5]), (450, [1.0, 2.0, 3.0, 4.0]), (450, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    rows = sorted({(i, tuple(v)) for i, v in x})
    for q in range(0, 500, 100):
        pairs = {(float(np.sqrt(np.cumsum((np.array(v) - np.array(u)) ** 2)[-1])), j) for i, u in rows if i == q for j, v in rows if j != q}
        assert sorted(got[q]) == sorted(pairs)[:10]


def _png(x, kind):
    h, w = x.shape
    raw, prev = b"", np.zeros(w, dtype=int)
    for line in x.astype(int):
        left = np.r_[0, line[:-1]]
        corner = np.r_[0, prev[:-1]]
        guess = {0: 0, 1: left, 2: prev, 3: (left + prev) // 2}.get(kind)
        if kind == 4:
            p = left + prev - corner
            d = np.array([abs(p - left), abs(p - prev), abs(p - corner)])
            guess = np.choose(d.argmin(0), [left, prev, corner])
        raw += bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        prev = line
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def _pgm(x):
    return b"P5 %d %d 255\n" % x.shape[::-1] + x.astype(np.uint8).tobytes()


def test_media_decoders():
    x = np.random.default_rng(0).integers(0, 256, (9, 7))
    for kind in range(5):
        assert (media.decode(_png(x, kind)) == x).all()
    assert (media.decode(_pgm(x)) == x).all() and media.decode(b"P5 x") is None and media.decode(b"") is None and media.decode(None) is None


def test_media_png_palettes_depths_and_channels():
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    file = lambda w, h, depth, color, raw, extra=b"", laced=0: b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, laced)) + extra + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    rng = np.random.default_rng(3)
    index, colors = rng.integers(0, 4, (5, 7)), rng.integers(0, 256, (4, 3))
    packed = np.packbits(np.pad(((index[:, :, None] >> np.array([1, 0])) & 1).reshape(5, -1), ((0, 0), (0, 2))), axis=1)
    raw = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in packed)
    got = media.decode(file(7, 5, 2, 3, raw, part(b"PLTE", colors.astype(np.uint8).tobytes())))
    assert np.allclose(got, colors[index].mean(axis=2))
    assert (media.decode(file(7, 5, 2, 0, raw)) == index * 85).all()
    rgb = rng.integers(0, 256, (5, 4, 3)).astype(np.uint8)
    left = np.concatenate([np.zeros((5, 1, 3), dtype=np.uint8), rgb[:, :-1]], axis=1)
    assert np.allclose(media.decode(file(4, 5, 8, 2, b"".join(b"\1" + r.tobytes() for r in rgb - left))), rgb.astype(float).mean(axis=2))
    assert media.decode(file(4, 5, 8, 2, b"", laced=1)) is None and media.decode(file(4, 5, 16, 0, b"")) is None


def test_media_finds_crops_and_edits(spark):
    rng = np.random.default_rng(11)
    side = lambda v: np.kron(np.clip(128 + 50 * v, 0, 255), np.ones((8, 8)))
    one, two, other = (side(rng.normal(size=(14, 14))) for _ in range(3))
    noisy = np.clip(one + rng.normal(0, 4, one.shape), 0, 255)
    images = [(1, _pgm(one)), (2, _pgm(noisy)), (3, _pgm(one[9:100, 5:103])), (4, _pgm(np.rot90(one))), (5, _pgm(np.clip(one * 0.8 + 20, 0, 255))), (10, _pgm(two)), (11, _pgm(two)), (12, _pgm(other)), (13, b"bad"), (14, b"bad"), (15, None), (16, None), (None, _pgm(other)), (17, _pgm(np.full((60, 60), 9)))]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in images], "image_id long, image binary")
    got = {}
    for r in media.copies(clashing(df)).collect():
        got.setdefault(r["image_id"], r)
    assert [got[i]["class_id"] for i in (1, 2, 3, 4, 5)] == [1] * 5 and all(got[i]["linked"] for i in (1, 2, 3, 4, 5))
    assert [got[i]["class_id"] for i in (10, 11, 12, 13, 14, 15, 16, 17)] == [10, 10, 12, 13, 13, 15, 16, 17] and not got[10]["linked"]
    assert got[None]["class_id"] == 12 and got[17]["corners"] == 0 and got[15]["corners"] == 0
    assert media.copies(df.limit(0)).count() == 0


def test_media_links_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(media, "CHUNK", 8)
    rng = np.random.default_rng(5)
    vectors = [v + 0.01 * rng.normal(size=64) for v in 0.12 * rng.normal(size=(6, 64)) for _ in range(15)]
    sigs = [media.describe(media.decode(media.mosaic(v))) for v in vectors]
    df = spark.createDataFrame([(i, bytearray(media.mosaic(v))) for i, v in enumerate(vectors)], "image_id long, image binary")
    corners = [np.frombuffer(s, dtype=media._CORNER) for s in sigs]
    ids = list(range(len(sigs)))
    label = ids[:]
    sets = [set(media.keys(s)) for s in sigs]
    for i in ids:
        for j in range(i):
            if sets[i] & sets[j] and media.consensus(corners[j], corners[i]) >= media.INLIERS:
                a, b = min(label[i], label[j]), max(label[i], label[j])
                label = [a if x == b else x for x in label]
    assert {r["image_id"]: r["class_id"] for r in media.copies(df).collect()} == dict(zip(ids, label, strict=True))


def test_media_pairs_that_share_a_corner_stay_in_their_tasks(spark, monkeypatch):
    """One corner in all images makes every two of them candidates, and few links; tables of pairs stay as long as that of images."""
    monkeypatch.setattr(media, "CHUNK", 16)
    rng = np.random.default_rng(9)
    images = []
    for _ in range(40):
        x = np.full((100, 200), 128.0)
        x[50:, :50] = 200
        x[:, 104:] = np.kron(np.clip(128 + 50 * rng.normal(size=(13, 12)), 0, 255), np.ones((8, 8)))[:100]
        images.append(x)
    images += [np.clip(x + 3, 0, 255) for x in images[::4]]
    blobs = [_pgm(x) for x in images]
    sigs = [media.describe(media.decode(b)) for b in blobs]
    corners, sets = [np.frombuffer(s, dtype=media._CORNER) for s in sigs], [set(media.keys(s)) for s in sigs]
    label, candidates = list(range(len(blobs))), 0
    for i in range(len(blobs)):
        for j in range(i):
            candidates += bool(sets[i] & sets[j])
            if sets[i] & sets[j] and media.consensus(corners[j], corners[i]) >= media.INLIERS:
                a, b = min(label[i], label[j]), max(label[i], label[j])
                label = [a if x == b else x for x in label]
    saved, save = [], Scratch.save

    def counting(self, df, name="t"):
        out = save(self, df, name)
        saved.extend([out.count()] if set(out.columns) == {"u", "v"} else [])
        return out

    monkeypatch.setattr(Scratch, "save", counting)
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "image_id long, image binary")
    assert {r["image_id"]: r["class_id"] for r in media.copies(df).collect()} == dict(enumerate(label))
    assert 20 < len(set(label)) <= 40 and candidates > 10 * len(blobs) and max(saved) <= 2 * len(blobs)


def _turned(x, degrees):
    """x turned about its centre, bilinear, edges repeated."""
    h, w = x.shape
    a = np.deg2rad(degrees)
    y, x0 = np.mgrid[:h, :w] - np.array([h / 2, w / 2])[:, None, None]
    sy, sx = np.clip(np.cos(a) * y - np.sin(a) * x0 + h / 2, 0, h - 1.001), np.clip(np.sin(a) * y + np.cos(a) * x0 + w / 2, 0, w - 1.001)
    i, j = sy.astype(int), sx.astype(int)
    fy, fx = sy - i, sx - j
    return (x[i, j] * (1 - fx) + x[i, j + 1] * fx) * (1 - fy) + (x[i + 1, j] * (1 - fx) + x[i + 1, j + 1] * fx) * fy


def test_media_links_turned_copies_as_all_pairs_do(spark):
    """Against consensus() of all pairs, without the filter by keys."""
    rng = np.random.default_rng(20)
    images = [np.kron(np.clip(128 + 50 * rng.normal(size=(14, 14)), 0, 255), np.ones((8, 8))) for _ in range(6)]
    images += [_turned(x, 20) for x in images]
    blobs = [_pgm(x) for x in images]
    corners = [np.frombuffer(media.describe(media.decode(b)), dtype=media._CORNER) for b in blobs]
    label = list(range(len(blobs)))
    for i in range(len(blobs)):
        for j in range(i):
            if media.consensus(corners[j], corners[i]) >= media.INLIERS:
                a, b = min(label[i], label[j]), max(label[i], label[j])
                label = [a if x == b else x for x in label]
    assert label == [*range(6), *range(6)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "image_id long, image binary")
    assert {r["image_id"]: r["class_id"] for r in media.copies(df).collect()} == dict(enumerate(label))


def test_media_finds_small_crops_of_large_images(spark):
    """The strongest corners of the whole lie outside the crop, a quarter of its area."""
    rng = np.random.default_rng(21)
    grid = rng.normal(size=(60, 60))
    grid[:30, :30] *= 0.4
    large = np.kron(np.clip(128 + 50 * grid, 0, 255), np.ones((8, 8)))
    other = np.kron(np.clip(128 + 50 * rng.normal(size=(30, 30)), 0, 255), np.ones((8, 8)))
    images = [(1, _pgm(large)), (2, _pgm(large[:240, :240])), (3, _pgm(large[:235, :233] * 0.9)), (4, _pgm(other))]
    got = {r["image_id"]: r for r in media.copies(spark.createDataFrame([(i, bytearray(b)) for i, b in images], "image_id long, image binary")).collect()}
    assert [got[i]["class_id"] for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert got[1]["corners"] == sum(len(media.corners(media.resize(media.decode(images[0][1]), s))) for s in media.SCALES)


def test_near_dedup_stage_joins_all_similar_texts(spark):
    """Against the Jaccard similarity of five-word shingles of all pairs."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(40)]
    for t in texts[:30]:
        for n in (1, 2, 3):
            t = t[:]
            for _ in range(n):
                t[rng.randrange(200)] = "other"
            texts.append(t)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    fps = [plain_fingerprint(" ".join(t)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = min(label[i], label[j]), max(label[i], label[j])
                label = [a if x == b else x for x in label]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(label)) and len(got) < len(simhash.keep_one(docs).collect())


def test_pipeline_against_its_parts(spark):
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from pyspark.sql import functions as F

    told = language_id.fit(table, F.lit(True))
    left = {i: r for i, r in docs.items() if told.predict(r["text"])[0] != "und" and told.predict(r["text"])[1] >= 0.5}
    kept = spark.createDataFrame(list(left.values()), table.schema)
    at, w, bias = toxicity.fit(kept, labels, F.lit(True))
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    toxic = lambda t: 1 / (1 + np.exp(-(sum(weight.get(k, 0.0) for k in toxicity.features(t).tolist()) + bias)))
    left = {i: r for i, r in left.items() if toxic(r["text"]) < 0.3}
    ids = sorted(left)
    part = plain_near(ids, [left[i]["text"] for i in ids])
    left = {i: left[i] for i, c in zip(ids, part, strict=True) if i == c}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in left.items()}
    got = corpus_pipeline.run(spark, d).collect()
    times = {}
    for r in got:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= set(left) and set(times.values()) <= {1, 2}
    sums, taken = {}, {}
    for i, r in left.items():
        sums[r["source"]] = sums.get(r["source"], 0) + sizes[i]
        taken[r["source"]] = taken.get(r["source"], 0) + sizes[i] * times.get(i, 0)
    want = mixing.targets(sums)
    for s, total in sums.items():
        sub = {0}
        for i, r in left.items():
            sub |= {x + sizes[i] for x in sub} if r["source"] == s else set()
        whole = int(want[s] // total)
        assert taken[s] == whole * total + max(x for x in sub if x <= round(want[s] - whole * total))
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r["n_tokens"] == len(enc.encode_ordinary(docs[r["doc_id"]]["text"])) for r in got)


def test_pipeline_stages_take_odd_documents(spark, tmp_path):
    docs = clashing(odd_documents(spark))
    spark.createDataFrame([(1, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (docs, docs.limit(0)):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()
