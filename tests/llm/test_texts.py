"""Language ID, quality, toxicity, licences, byte BPE: brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pyspark.sql import functions as F

from tests.llm.data import clashing, odd_documents, odd_labels, rows_of
from trendloom.llm import byte_bpe, language_id, licenses, quality, toxicity
from trendloom.llm.common import drawn, labelled_sample
from trendloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.mark.parametrize("run", [
    lambda s, d: language_id.identify(d), lambda s, d: quality.quality(d, odd_labels(s)), lambda s, d: toxicity.toxicity(d, odd_labels(s)),
    lambda s, d: licenses.scan(d), lambda s, d: byte_bpe.encode_table(d, PATH, public_tokenizers.PATTERN),
], ids=["language", "quality", "toxicity", "licenses", "bpe"])
def test_odd_rows(spark, run):
    docs = odd_documents(spark)
    got = run(spark, docs)
    assert got.count() == docs.count()
    assert rows_of(got) == rows_of(run(spark, clashing(docs).repartition(5)))
    empty = run(spark, docs.limit(0))
    assert empty.count() == 0 and empty.columns == got.columns


def test_languages(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_rules(spark):
    got = {r["doc_id"]: r for r in language_id.identify(odd_documents(spark)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (4, 5, 6, 7))
    model = language_id.Model(["de", "en"], {"haus": np.array([5.0, 0.0]), "house": np.array([0.0, 5.0])})
    assert model.predict("house")[0] == "en" and model.predict("hausen")[0] == "de" and model.predict("mouse")[0] == "en"
    assert (model.backed_off("hausen") == model.gram_log[5][[model.gram_of[5][g] for g in language_id.grams("hausen", 5) if g in model.gram_of[5]]].mean(0)).all()
    assert model.predict("") == ("und", 0.0) and language_id.Model([], {}).predict("a") == ("und", 0.0)
    assert language_id.keep_identified(odd_documents(spark)).columns == odd_documents(spark).columns


def test_language_letters_and_rare_languages(spark):
    """Numbers that aren't decimal digits are no letters, marks belong to words, and a language of few rows is predicted."""
    assert language_id.words("½ ² ① Ⅷ 12_3") == [] and language_id.words("हिन्दी É́a x1y") == ["हिन्दी", "é́a", "x", "y"]
    rows = [(i, f"the house is {i % 7} and old and the tree is tall", "en") for i in range(3000)] + [(10_000 + i, "umuntu ngumuntu ngabantu", "zu") for i in range(3)] + [(20_000, "½ Ⅷ", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), sample=200, keep=4)
    assert model.langs == ["en", "zu"] and model.predict("umuntu")[0] == "zu" and model.predict("the tree")[0] == "en" and model.predict("½ Ⅷ") == ("und", 0.0)


def test_samples_of_huge_tables_are_not_empty(spark):
    """Shares far below a millionth still draw; odds come from the rows that were drawn."""
    n = spark.range(20_000_000).where(drawn("id", 4e-7, 5)).count()
    assert 1 <= n <= 25
    assert spark.range(10).where(drawn("id", 1.0, 5)).count() == 10 and spark.range(10).where(drawn("id", F.lit(0.0), 5)).count() == 0
    labels = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 == 0).cast("int").alias("toxic"))
    rows, odds = labelled_sample(labels, "toxic", F.lit(True), 2000, 3)
    got = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    assert 900 < got[0] < 1100 and 900 < got[1] < 1100 and odds == pytest.approx(np.log(got[0] / 196_000 / (got[1] / 4000)))


def test_lasso_reaches_its_optimum():
    rng = np.random.default_rng(6)
    a = (rng.random((900, 300)) < rng.random(300)).astype(float)
    a[:, 100:200] = a[:, :100]  # the same columns twice make the curvature large
    y = (a[:, 0] + a[:, 5] + rng.normal(size=900) > 1).astype(float)
    w, b = quality.lasso_logistic(a, y, 0.01)
    x = np.hstack([a, np.ones((900, 1))])
    assert quality.gap(x, y, np.append(w, b), 0.01) <= 1e-4 and 0 < (w != 0).sum() < 100
    loss = lambda v: np.log1p(np.exp(-(2 * y - 1) * (x @ v))).mean() + 0.01 * np.abs(v[:-1]).sum()
    best = loss(np.append(w, b))
    assert all(loss(np.append(w, b) + 0.01 * rng.normal(size=301)) > best for _ in range(50))


def test_quality_rules_by_hand():
    """Each rule is the path to a node whose split no other threshold beats, and covers() says where all its conditions hold."""
    rng = np.random.default_rng(1)
    x = rng.random((400, 3))
    y = ((x[:, 1] > 0.5) & (x[:, 2] <= 0.3)).astype(float)
    rules = quality.extract_rules(x, y)
    assert rules and all(1 <= len(r) <= quality.DEPTH for r in rules) and len(set(rules)) == len(rules)
    for r in rules:
        assert (quality.covers(x, r) == [all((row[j] > cut) == above for j, cut, above in r) for row in x]).all()
    found = []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.CUTS + 1)[1:-1])) for j in range(3)]
    quality._tree(x, cuts, y - y.mean(), np.arange(400), 1, (), found)
    gain = {}
    for j in range(3):
        for cut in cuts[j]:
            at = x[:, j] > cut
            if quality.LEAF <= at.sum() <= 400 - quality.LEAF:
                r = y - y.mean()
                gain[j, cut] = r[at].sum() ** 2 / at.sum() + r[~at].sum() ** 2 / (~at).sum()
    assert found[0][0][:2] == max(gain, key=gain.get)


def test_toxic_features_by_hand(spark):
    """Slots of words, pairs and pairs that skip one, against their definition, and the query's scores from its own weights."""
    def plain(text):
        ws = [zlib.crc32(w.lower()) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
        mask = (1 << 64) - 1
        pairs = [((ws[i] * 0x9E3779B185EBCA87 + ws[i + gap]) * odd & mask) for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)) for i in range(len(ws) - gap)]
        return sorted({v >> 44 for v in [w * 0x9E3779B97F4A7C15 & mask for w in ws] + pairs})

    texts = ["You, YOU are a-b é漢 1x!", "one", "", "a b a b a c"]
    for t in texts:
        assert toxicity.features(t).tolist() == plain(t)
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    keep = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    at, w, bias = toxicity.fit(docs, labels, keep)
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    text_of = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in QUERIES["op10_toxicity"](spark, d).collect():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-bias - sum(weight.get(k, 0.0) for k in plain(text_of[r["doc_id"]])))), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxicity_ids_of_any_type_and_wordless_texts(spark):
    rows = [(f"d{i}", "you are awful scum" if i % 2 else "a fine day in the park") for i in range(60)] + [("e1", None), ("e2", ""), ("e3", "?! --")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2) for i in range(60)], "doc_id string, toxic int")
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {f"d{i}" for i in range(0, 60, 2)} | {"e1", "e2", "e3"}
    assert toxicity.keep_clean(docs, labels.limit(0)).count() == 63


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) for r in got)


def test_rules_compile_to_what_numpy_gives(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5)).astype(float)
    model = quality.RuleEnsemble.learn(["a", "b", "c"], x, y)
    assert 0 < len(model.rules) <= quality.RULES and ((model.predict(x) >= 0.5) == y).mean() > 0.95
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    from pyspark.sql import functions as F

    got = [r["s"] for r in df.select(model.score({c: F.col(c) for c in "abc"}).alias("s")).collect()]
    assert np.allclose(got, model.predict(x))
    assert quality.RuleEnsemble.learn(["a"], np.zeros((0, 1)), np.zeros(0)).predict(np.zeros((1, 1)))[0] == 0.5


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, p = np.array([r["toxic"] for r in got]), np.array([r["predicted"] for r in got])
    assert (y == p).mean() > 0.94 and y[p == 1].mean() > 0.95


def test_ftrl_against_plain_loop():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(16, 4, replace=False)), float(rng.integers(2))) for _ in range(60)]
    z, n, bias, bn = [0.0] * 16, [0.0] * 16, 0.0, 0.0
    a, b, l1, l2 = 1.0, 1.0, 3.0, 1.0
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((b + n[i] ** 0.5) / a + l2)
    for _ in range(8):
        for at, y in rows:
            ws = {i: w(i) for i in at}
            g = 1 / (1 + np.exp(-(sum(ws.values()) + bias))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a * ws[i]
                n[i] += g * g
            bn += g * g
            bias -= a / (b + bn**0.5) * g
    at, got, gb = toxicity.train(rows, bits=4)
    assert np.allclose([w(i) for i in range(16) if w(i)], got) and gb == pytest.approx(bias) and list(at) == [i for i in range(16) if w(i)]


def test_licenses_against_brute_force(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for r in docs.collect():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        hits = [(i, label) for label, p in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(ws), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert g["base_labels"] == ",".join(sorted({h[1] for h in hits})) and {h[1] for h in hits} <= set(filter(None, g["labels"].split(",")))


def test_bpe_needs_every_byte():
    c = byte_bpe.Codec({b"a": 0, b"b": 1, b"ab": 2}, r"\w+")
    assert c.encode("abb") == [2, 1]
    for text in ("ac", "ca", "c"):
        with pytest.raises(ValueError):
            c.encode(text)


def test_license_templates():
    index = licenses.Index()
    for label, text, _ in licenses.TEMPLATES:
        said = index.scan("some words before it. " + text + " and after it")
        assert label in said[5].split(",") and said[6] > 0.9, label
    assert index.scan("the license of the software is not the point")[5] == ""
    assert index.scan("Licensed under the Apache Licence, Version 9")[5] == ""
    assert index.scan(None) == (0, 0, None, None, "", "", 0.0)
    assert index.scan("THE MIT license the mit License")[:4] == (6, 2, 0, 3)


def plain_labels(index, ws):
    """The labels of all templates, by trying every relative position of every rare word, without the index."""
    out = set()
    for k, rare in enumerate(index.rare):
        offsets = {}
        for at, w in enumerate(ws):
            for p in rare.get(w, ()):
                offsets.setdefault(at - p, set()).add(p)
        for o in offsets:
            agree = set().union(*(offsets.get(o + d, set()) for d in range(index.shift[k] + 1)))
            window = ws[max(0, o) : max(0, o + len(index.texts[k]) + index.shift[k])]
            if len(agree) >= licenses.AGREE * index.size[k] and all(licenses.stands(window, key) for key in index.keys[k]):
                out.add(index.labels[k])
    return out


def test_license_labels_against_all_positions():
    """The index looks up few words of a file; the labels are those of a search by all words at all places."""
    index, rng = licenses.Index(), random.Random(8)
    docs = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    filler = " ".join(docs[:3]).split()
    for _ in range(400):  # notices with words lost, replaced, inserted, and cut at either end
        ws = [w for w in licenses.words(rng.choice(licenses.TEMPLATES)[1]) if rng.random() > rng.choice((0, 0.1, 0.3))]
        ws = [x for w in ws for x in ((w, "dnl") if rng.random() < 0.15 else (w,))]
        cut = rng.randint(0, max(0, len(ws) // 3))
        docs.append(" ".join([*rng.sample(filler, 20), *(ws[cut:] if rng.random() < 0.5 else ws[: len(ws) - cut]), *rng.sample(filler, 20)]))
    found = 0
    for text in docs:
        ws = licenses.words(text)
        got = set(index.matches(ws, index.vocabulary.intersection(ws)))
        assert got == plain_labels(index, ws), text[:300]
        found += bool(got)
    assert found > 150


@pytest.mark.parametrize(("text", "label"), [
    ("# SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3"), ("Dual: Apache-2.0", "apache-2"), ("see LGPL-2.1-only for terms", "lgpl-2.1"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    ("dnl Permission is hereby granted, free of charge, to any person\ndnl obtaining a copy of this software and associated documentation\ndnl files (the Software), to deal in the Software without restriction,\ndnl including without limitation the rights to use, copy, modify,\ndnl merge, publish, distribute, sublicense, and/or sell copies", "mit"),
    ("REM This work is licensed under the GNU General Public REM License, version 3", "gpl-3"),
])
def test_license_partial_notices(text, label):
    assert label in licenses.Index().scan("a b c " + text + " d e f")[5].split(",")


def test_license_base_columns_against_sql(spark):
    """What the contract fixes, said in SQL."""
    said = "UNION ALL ".join(f"SELECT doc_id, i - 1 AS at, '{label}' AS label FROM w, unnest(range(1, len(ws) + 1)) AS u(i) WHERE ws[i:i + {len(p.split()) - 1}] = {p.split()} " for label, p in licenses.PHRASES.items())
    sql = f"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM '/root/testdata/sf0.01/documents.parquet'),
        h AS ({said})
        SELECT w.doc_id, len(any_value(ws)), count(at), min(at), max(at), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM w LEFT JOIN h USING (doc_id) GROUP BY 1
    """
    got = QUERIES["op5_licenses"](spark, "/root/testdata/sf0.01").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


def test_bpe_is_tiktoken(codec, reference):
    rng = random.Random(4)
    alphabet = "ab e\n\t\r\x1c\x85\xa0  'stre1299.,!?éß漢字😀́İıſKⅧ²"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "a" * 5000, " " * 3000 + "x", "ab" * 3000, "é" * 999, "1" * 777]
    for t in texts:
        ids = codec.encode(t)
        assert ids == reference.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_prefix_state_edits(codec):
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(b"abceheth ingtion\xc3\xa9") for _ in range(rng.randint(0, 90)))
        cut = rng.randint(0, len(data))
        state = byte_bpe.PrefixState(codec, data[:cut])
        state.append(data[cut:])
        assert state.ids() == codec.merge(data)
        i = rng.randint(0, len(data))
        j, new = rng.randint(i, len(data)), bytes(rng.choice(b"abeth") for _ in range(rng.randint(0, 4)))
        state.replace(i, j, new)
        assert state.ids() == codec.merge(data[:i] + new + data[j:])


def test_bpe_query(spark, reference):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in QUERIES["op9_byte_bpe"](spark, d).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
