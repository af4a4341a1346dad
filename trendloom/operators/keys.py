"""Keys, corpus preparation, and the joins that put tables side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trendloom.functions.text import clean, foreign_letters, parse_year, stable_id
from trendloom.functions.vocabulary import KEYWORD_COLUMNS

ALIASES = {"topic_id": "topic", "Topic": "topic", "document_id": "doc_id", "docid": "doc_id", "id": "doc_id"}


def normalize_columns(df: DataFrame) -> DataFrame:
    """Renames known aliases to topic and doc_id where those don't exist yet; doc_id becomes a string."""
    for old, new in ALIASES.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumn("doc_id", F.col("doc_id").cast("string")) if "doc_id" in df.columns else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Df, if it has the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def assert_present(df: DataFrame, column: str) -> DataFrame:
    """Df; reading a row whose column is null fails."""
    return df.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} is null"))).otherwise(F.col(column)))


def unique_ids(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The second and later rows of a key get __dup1, __dup2 and so on, in the given order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    k = F.col(key).cast("string")
    return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 0, F.concat(k, F.lit("__dup"), F.col("_n").cast("string"))).otherwise(k)).drop("_n")


def preprocess(raw: DataFrame, title: str = "english_title", abstract: str = "abstract_en", kind: str = "thesis_type", year: str = "year", max_foreign: int = 0) -> DataFrame:
    """Ids, cleaned fields, text, a flag for foreign titles, and readable years only."""
    require(raw, [title, abstract, kind, year])
    given = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if "doc_id" in raw.columns else F.lit("")
    made = stable_id(kind, title, year, abstract)
    out = raw.withColumns({
        "doc_id": F.when(given != "", given).otherwise(made), f"{title}_clean": clean(title), f"{abstract}_clean": clean(abstract),
        "year": parse_year(year), "flag_non_english_title": foreign_letters(title) > max_foreign,
    })
    return out.withColumn("text", clean(F.concat(f"{title}_clean", F.lit(". "), f"{abstract}_clean"))).where("year > 1000")


def backfill(doc_topics: DataFrame, corpus: DataFrame, columns: list[str]) -> DataFrame:
    """Fills missing values of columns from the corpus, one row of it for each doc_id (the smallest)."""
    one = corpus.groupBy("doc_id").agg(*[F.min(c).alias(f"_{c}") for c in columns])
    out = doc_topics.join(one, "doc_id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"_{c}") if c in doc_topics.columns else F.col(f"_{c}"))
    return out.drop(*[f"_{c}" for c in columns])


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns in order; those df lacks are empty strings."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def numeric(column: Column | str, default: float | None = None) -> Column:
    """A double; ``default`` where the value is missing, NaN or can't be read."""
    x = (F.col(column) if isinstance(column, str) else column).cast("string").try_cast("double")
    x = F.when(~F.isnan(x), x)
    return x if default is None else F.coalesce(x, F.lit(default))


def keyword_column(topics: DataFrame) -> Column:
    """The keywords of topics: the first of the known columns that isn't empty."""
    found = [F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in KEYWORD_COLUMNS if c in topics.columns]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")


def z_score(df: DataFrame, column: str, out: str) -> DataFrame:
    """Standardised by the population's deviation; 1 in place of a deviation of 0."""
    s = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_d"))
    return df.join(F.broadcast(s), F.lit(True)).withColumn(out, (F.col(column) - F.col("_m")) / F.when(F.col("_d") == 0, 1.0).otherwise(F.col("_d"))).drop("_m", "_d")


def is_doctorate(kind: Column | str) -> Column:
    """P15."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.coalesce(F.regexp_like(F.lower(k), F.lit("doctor|dokto|phd")), F.lit(False)).cast("int")


def topic_cards(topics: DataFrame, *tables: DataFrame) -> DataFrame:
    """Topics with the rows of each further table for the same topic, one of each (the smallest by all columns)."""
    out = topics
    for t in tables:
        rest = [c for c in t.columns if c != "topic"]
        one = t.groupBy("topic").agg(F.min(F.struct(*rest)).alias("_s")).select("topic", "_s.*")
        out = out.join(one, "topic", "left")
    return out


def examples(doc_topics: DataFrame, n: int = 3, recent: bool = False, texts: DataFrame | None = None) -> DataFrame:
    """Up to n documents of each topic, surest first (or latest, then surest), with the columns of texts (doc_id, ...) if given."""
    order = [F.desc("year"), F.desc("assignment_confidence"), "doc_id"] if recent else [F.desc("assignment_confidence"), F.desc("year"), "doc_id"]
    w = Window.partitionBy("topic").orderBy(*order)
    out = doc_topics.where("topic <> -1").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out if texts is None else out.join(texts, "doc_id", "left")
