"""Queries of cleaning, tokens, labels and keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions.text import (
    clean_label,
    coherence_tokens,
    collision_key,
    grams_of,
    is_weak_label,
    label_tokens,
    nfkc,
    parse_keywords,
    parse_list,
    quotes,
    repair_breaks,
    slug,
    squeeze,
    unify_dashes,
    unigrams,
    words_of,
)
from trendloom.functions.vocabulary import GENERIC_LABEL_WORDS, STOP_WORDS
from trendloom.operators.concepts import mark_ambiguous
from trendloom.operators.keywords import coherence, ctfidf, diversity, finalize, refine, token_documents
from trendloom.plans.registry import query, rounded
from trendloom.plans.views import corpus, spread, table

V4_SQL = "v4 AS (SELECT doc_id, text, lang, nullif(regexp_extract(source, '([0-9]+)$', 1), '')::INTEGER AS topic FROM documents)"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _joined(c):
    return F.md5(F.array_join(c, " "))


@query("p3_repair_breaks", r"""
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([A-Za-z0-9_])-[ \t]*\n\s*([A-Za-z0-9_])', '\1\2', 'g'), '[\r\n]+', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents
""")  # fmt: skip
def p3(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(repair_breaks("text")).alias("h"))


@query("p5_nfkc")
def p5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(squeeze(unify_dashes(nfkc("text")))).alias("h"))


@query("t1_collision_key", "SELECT p_partkey, trim(regexp_replace(lower(p_name || '/' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS k FROM part")
def t1(spark, d):
    return table(spark, d, "part").select("p_partkey", collision_key(F.concat("p_name", F.lit("/"), "p_brand")).alias("k"))


@query("t2_slug", "SELECT page_id, translate(list_extract(string_split(url, '/'), -1), '_', ' ') AS s FROM pages")
def t2(spark, d):
    return table(spark, d, "pages").select("page_id", slug("url").alias("s"))


@query("t4_ambiguous", """
    WITH k AS (SELECT p_partkey, p_name AS text, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part),
    n AS (SELECT k, count(DISTINCT p_partkey) AS n FROM k GROUP BY 1)
    SELECT p_partkey::VARCHAR AS uri, text, n > 1 AS ambiguous FROM k JOIN n USING (k)
    WHERE NOT (n > 1 AND (length(text) <= 4 OR (len(string_split(k, ' ')) = 1 AND length(text) <= 6)))
""")  # fmt: skip
def t4(spark, d):
    return mark_ambiguous(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("uri"), F.col("p_name").alias("text")))


@query("t5_parse_list", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 8 THEN p_name ELSE p_name || '|' || p_brand END AS items FROM part")
def t5(spark, d):
    """Nine forms of a list, one for each part in turn; items that repeat count once."""
    n, b = F.col("p_name"), F.col("p_brand")
    forms = [
        F.concat(F.lit("['"), n, F.lit("', '"), b, F.lit("', '"), n, F.lit("']")), F.concat(F.lit('["'), n, F.lit('", "'), b, F.lit('"]')), F.concat(n, F.lit(";"), b, F.lit("; ")), F.concat(n, F.lit(" | "), b),
        F.concat(n, F.lit(", "), b, F.lit(","), n), F.concat(F.lit("('"), n, F.lit("', '"), b, F.lit("')")), F.concat(F.lit("{'"), n, F.lit("', '"), b, F.lit("'}")), F.concat(F.lit("  ["), F.lit('"'), n, F.lit('","'), b, F.lit('"]  ')), n,
    ]
    form = F.element_at(F.array(*forms), (F.col("p_partkey") % 9 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.array_join(parse_list(form), "|").alias("items"))


@query("t6_keywords", "SELECT p_partkey, lower(p_name) || '+' || lower(p_brand) AS kws FROM part")
def t6(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(parse_keywords(F.concat("p_name", F.lit("; "), "p_brand", F.lit(", "), "p_name")), "+").alias("kws"))


@query("t8_unigrams", f"""
    SELECT doc_id, len(x)::INTEGER AS n, md5(array_to_string(list_sort(x), ' ')) AS h
    FROM (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}')), lambda w: NOT list_contains({STOP_SQL}, w)) AS x FROM documents)
""")  # fmt: skip
def t8(spark, d):
    x = unigrams("text", STOP_WORDS)
    return table(spark, d, "documents").select("doc_id", x.alias("x")).select("doc_id", F.size("x").alias("n"), _joined(F.sort_array("x")).alias("h"))


@query("t9_coherence_tokens", "SELECT doc_id, len(x)::INTEGER AS n, md5(array_to_string(x, ' ')) AS h FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_][a-z0-9]+)*') AS x FROM documents)")
def t9(spark, d):
    return table(spark, d, "documents").select("doc_id", coherence_tokens("text").alias("x")).select("doc_id", F.size("x").alias("n"), _joined("x").alias("h"))


@query("t10_terms", f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x)) AS w FROM documents)
    SELECT doc_id, (len(w) + greatest(len(w) - 1, 0))::INTEGER AS n, md5(array_to_string(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]), ' ')) AS h FROM w
""")  # fmt: skip
def t10(spark, d):
    words = table(spark, d, "documents").select("doc_id", words_of("text", STOP_WORDS).alias("ws"))
    return words.select("doc_id", grams_of("ws").alias("x")).select("doc_id", F.size("x").alias("n"), _joined("x").alias("h"))


_GENERIC_SQL = "[" + ", ".join(f"'{w}'" for w in GENERIC_LABEL_WORDS) + "]"


@query("t12_weak_label", rf"""
    WITH k AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s/_\-]+', ' ', 'g')) AS low FROM documents),
    t AS (SELECT *, list_filter(regexp_split_to_array(low, '[\s/_\-]+'), lambda x: x <> '') AS ts FROM k)
    SELECT doc_id, len(ts)::INTEGER AS n, len(ts) = 0 OR low IN ('misc', 'other', 'others', 'unknown', 'general', 'topic')
        OR (len(ts) = 1 AND (list_contains({_GENERIC_SQL}, ts[1]) OR length(ts[1]) < 4))
        OR (len(ts) <= 2 AND len(list_filter(ts, lambda x: NOT list_contains({_GENERIC_SQL}, x))) = 0) AS weak FROM t
""")  # fmt: skip
def t12(spark, d):
    docs = spread(table(spark, d, "documents")).select("doc_id", "text", label_tokens("text").alias("ts"))
    return docs.select("doc_id", F.size("ts").alias("n"), is_weak_label("text", tokens="ts").alias("weak"))


@query("t15_clean_label", "SELECT p_partkey, p_name AS label FROM part")
def t15(spark, d):
    raw = F.concat(F.lit('```json\n3. Topic: "'), F.translate("p_name", " ", "\t"), F.lit('"\n```'))
    return table(spark, d, "part").select("p_partkey", clean_label(raw).alias("label"))


@query("t17_quotes", "SELECT doc_id, true AS quoted, contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'the on') AS found FROM documents".replace("\\\\", "\\"))
def t17(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", quotes("text", F.concat(F.lit("\n "), F.regexp_replace("text", " ", "  "), F.lit("\t"))).alias("quoted"), quotes("text", F.lit(" the \n on "), True).alias("found"))


@query("a13_token_documents", f"""
    WITH {V4_SQL}, t AS (SELECT topic, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}'))) AS token FROM v4 WHERE topic <> -1)
    SELECT token, topic, count(*) AS df FROM t GROUP BY 1, 2
""")  # fmt: skip
def a13(spark, d):
    return token_documents(corpus(spark, d))


def _terms_sql(longest: int = 2) -> str:
    """CTE kw(topic, rank, term, score) of the best terms of each topic in two documents or more."""
    grams = "w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])" if longest == 2 else "w"
    return f"""
    {V4_SQL}, w AS (SELECT doc_id, topic, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x)) AS w FROM v4 WHERE topic <> -1),
    t AS (SELECT doc_id, topic, unnest({grams}) AS term FROM w),
    c AS (SELECT topic, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY 1, 2),
    s AS (SELECT term, sum(df) AS docs, count(*) AS cdf FROM c GROUP BY 1 HAVING sum(df) >= 2),
    k AS (SELECT topic, term, tf, cdf, sum(tf) OVER (PARTITION BY topic) AS a FROM c JOIN s USING (term)),
    f AS (SELECT topic, term, round(tf / a * (ln((1.0::DOUBLE + (SELECT count(DISTINCT topic) FROM k)) / (1.0::DOUBLE + cdf)) + 1.0::DOUBLE), 12) AS score FROM k),
    kw AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term)::INTEGER AS rank, term, score FROM f WHERE score > 0)"""


_TERMS_SQL = _terms_sql()


@query("m10_ctfidf", f"WITH {_TERMS_SQL} SELECT topic, rank, term, round(score, 6) AS score FROM kw WHERE rank <= 15")
def m10(spark, d):
    return rounded(ctfidf(corpus(spark, d), 15, 2, STOP_WORDS))


@query("q17_diversity", f"WITH {_TERMS_SQL} SELECT round(count(DISTINCT term) / count(*), 6) AS diversity FROM kw WHERE rank <= 20")
def q17(spark, d):
    return rounded(diversity(ctfidf(corpus(spark, d), 20, 2, STOP_WORDS)))


@query("m14_finalize", f"""
    WITH {_TERMS_SQL}, k15 AS (SELECT * FROM kw WHERE rank <= 15), top AS (SELECT topic, max(score) AS top, string_agg(term, '; ' ORDER BY rank) AS keywords FROM k15 GROUP BY 1),
    fine AS (SELECT topic, rank, term, score, row_number() OVER (PARTITION BY topic ORDER BY rank) AS i FROM k15 WHERE length(trim(term)) >= 3 AND NOT list_contains({_GENERIC_SQL}, lower(trim(term)))),
    heavy AS (SELECT fine.*, row_number() OVER (PARTITION BY topic ORDER BY rank) AS j FROM fine JOIN top USING (topic) WHERE i = 1 OR top <= 0 OR score >= 0.35 * top),
    made AS (SELECT topic, string_agg(term, ' / ' ORDER BY j) AS label FROM heavy WHERE j <= 3 GROUP BY 1), plain AS (SELECT topic, string_agg(term, ' / ' ORDER BY rank) AS label FROM k15 WHERE rank <= 3 GROUP BY 1),
    sizes AS (SELECT topic, count(*) AS size FROM v4 WHERE topic <> -1 GROUP BY 1)
    SELECT topic, coalesce(made.label, plain.label, 'Topic ' || topic) AS label, coalesce(keywords, '') AS keywords, size FROM sizes LEFT JOIN made USING (topic) LEFT JOIN plain USING (topic) LEFT JOIN top USING (topic)
""")  # fmt: skip
def m14(spark, d):
    docs = corpus(spark, d)
    topics = docs.select("topic").distinct().withColumn("label", F.concat(F.lit("Topic "), F.col("topic").cast("string")))
    return finalize(docs, topics, 15, 2, STOP_WORDS)


@query("m15_refine")
def m15(spark, d):
    docs = corpus(spark, d)
    kws = ctfidf(docs, 15, 2, STOP_WORDS).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    topics = kws.select("topic", F.array_join(F.transform("k", lambda k: k["term"]), "; ").alias("keywords"))
    return refine(docs, topics, stop=STOP_WORDS)


def _npmi_sql(na: str, nb: str, nab: str) -> str:
    return f"CASE WHEN {nab} <= 0 OR -ln({nab} / nw + 1e-12) <= 0 THEN -1.0 ELSE ln({nab} / nw / ({na} / nw * {nb} / nw) + 1e-12) / -ln({nab} / nw + 1e-12) END"


COHERENCE_SQL = f"""
    {_terms_sql(1)}, words AS (SELECT DISTINCT topic, term AS word FROM kw WHERE rank <= 10),
    tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[-_][a-z0-9]+)*') AS ts FROM documents), wn AS (SELECT doc_id, ts, greatest(len(ts) - 19, 1) AS w FROM tok),
    tot AS (SELECT sum(w)::DOUBLE AS nw, count(*) AS nd FROM wn), po AS (SELECT doc_id, w, unnest(ts) AS word, generate_subscripts(ts, 1) - 1 AS p FROM wn),
    hit AS (SELECT * FROM po WHERE word IN (SELECT word FROM words)), ww AS (SELECT DISTINCT doc_id, word, unnest(range(greatest(p - 19, 0), least(p, w - 1) + 1)) AS s FROM hit),
    dw AS (SELECT word, count(DISTINCT doc_id) AS df FROM hit GROUP BY 1), sw AS (SELECT word, count(*) AS n FROM ww GROUP BY 1),
    kept AS (SELECT topic, word, n FROM words JOIN dw USING (word) JOIN sw USING (word), tot WHERE df >= 1 AND df <= 0.95 * nd),
    tp AS (SELECT a.topic, a.word AS a, b.word AS b, a.n AS na, b.n AS nb FROM kept a JOIN kept b ON a.topic = b.topic AND a.word < b.word),
    both_ AS (SELECT x.word AS a, y.word AS b, count(*) AS nab FROM ww x JOIN ww y ON x.doc_id = y.doc_id AND x.s = y.s AND x.word < y.word GROUP BY 1, 2),
    pr AS (SELECT topic, tp.a, tp.b, {_npmi_sql("na", "nb", "coalesce(nab, 0)")} AS x FROM tp LEFT JOIN both_ USING (a, b), tot),
    fl AS (SELECT topic, a, b, x FROM pr UNION ALL SELECT topic, b, a, x FROM pr UNION ALL SELECT topic, word, word, 1.0 FROM kept),
    tv AS (SELECT topic, b, sum(x) AS t FROM fl GROUP BY 1, 2), cs AS (SELECT topic, a, sum(x * t) / greatest(sqrt(sum(x * x)) * sqrt(sum(t * t)), 1e-12) AS c FROM fl JOIN tv USING (topic, b) GROUP BY 1, 2),
    coh AS (SELECT topic, (SELECT count(*) FROM kept k WHERE k.topic = m.topic) AS words, c_npmi, c_v FROM (SELECT topic, avg(x) AS c_npmi FROM pr GROUP BY 1) m JOIN (SELECT topic, avg(c) AS c_v FROM cs GROUP BY 1) USING (topic))"""


def coherence_keywords(spark, d):
    """The ten best words of each topic of the corpus."""
    return ctfidf(corpus(spark, d), 10, 2, STOP_WORDS, 1).select("topic", "term")


@query("q16_coherence", f"WITH {COHERENCE_SQL} SELECT topic, words, round(c_npmi, 6) AS c_npmi, round(c_v, 6) AS c_v FROM coh")
def q16(spark, d):
    return rounded(coherence(corpus(spark, d), coherence_keywords(spark, d)))
