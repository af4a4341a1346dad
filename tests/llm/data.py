"""Small tables with nulls, empty and long texts, repeats and columns with clashing names."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    base = "The quick brown fox jumps over the lazy dog and runs far away into the deep dark wood "
    rows = [
        (1, base, "en", "a", 3), (2, base.upper(), "en", "a", None), (3, base + "now", None, None, 1), (3, base + "now", None, None, 1), (4, None, "en", "a", 0), (5, "", None, "b", 0),
        (6, "   \n\t ", "fr", "b", 2), (7, "123 !!! ###", "de", None, 9), (8, base * 2000, "en", "c", 5), (None, "le chat est sur la table", "fr", "a", 1), (9, "un", "es", "é", 1),
        (10, "😀 中文 Straße ﬁ\u0000x", "de", "\U00010000", 1), (11, "el perro come en la casa grande", "es", "a", 1), (12, base, "en", "b", 2),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """df with columns more that have names operators use."""
    for c in ("score", "size", "fp", "held_out", "prediction", "taken", "copies", "target", "bucket", "component_id", "y", "n", "fingerprint", "digest", "first"):
        df = df.withColumn(c, F.lit("x"))
    return df


def odd_labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 0, 1), (4, None, None), (None, 1, 1), (5, 1, 0), (8, 1, 1), (11, 0, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def rows_of(df):
    return sorted(map(str, df.collect()))
