"""Tables from files, and files from tables."""

from __future__ import annotations

import codecs
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
#: Names that an artifact may have in a run's folder, the first that exists counts.
ARTIFACTS = {
    "doc_topics": ["09_final_doc_topics", "07_llm_gated_doc_topics", "06_reassigned_doc_topics", "04_bertopic_doc_topics", "doc_topics"],
    "topics": ["09_final_topics", "04_bertopic_topics", "topics"],
    "corpus": ["01_preprocessed_documents", "corpus"],
    "trends": ["10_topic_trends"],
    "shift": ["11_semantic_shift"],
    "prevalence": ["13_prevalence_baseline"],
}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def file_encoding(spark: SparkSession, path: str, chunk: int = 8 << 20) -> str:
    """The first of ENCODINGS that all the files' bytes are, read where the files are in chunks, so that no task holds a file."""

    @F.pandas_udf("int")
    def first(s: pd.Series) -> pd.Series:
        def fits(name: str, encoding: str) -> bool:
            fs, p = _filesystem(name)
            decoder = codecs.getincrementaldecoder(encoding)()
            with fs.open_input_stream(p) as f:
                try:
                    while data := f.read(chunk):
                        decoder.decode(data)
                    decoder.decode(b"", final=True)
                except UnicodeDecodeError:
                    return False
            return True

        return s.map(lambda name: next((i for i, e in enumerate(ENCODINGS[:-1]) if fits(name, e)), len(ENCODINGS) - 1)).astype("int32")

    worst = spark.read.format("binaryFile").load(path).select("path").agg(F.max(first("path"))).first()[0]
    return ENCODINGS[worst or 0]


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, lenient: bool = False, multi_line: bool = True) -> DataFrame:
    """CSV with a header, quoted line breaks and any of ENCODINGS; doc_id is a string.

    ``lenient`` drops lines that don't fit the schema; else they fail the read. Without a
    schema all columns are strings. Files whose fields hold no line break are split over tasks
    with ``multi_line`` off; else each is one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    encoding = file_encoding(spark, path)
    reader = reader.option("encoding", "UTF-8" if encoding == "UTF-8" else "ISO-8859-1").option("mode", "DROPMALFORMED" if lenient else "FAILFAST")
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    first = df.columns[0]
    df = df.withColumnRenamed(first, first.lstrip("\ufeff"))
    if encoding == "windows-1252":  # Spark reads no such files; where Latin-1 has control characters, these have others
        codes = [c for c in range(128, 160) if bytes([c]).decode("windows-1252", "ignore")]
        low, high = "".join(map(chr, codes)), bytes(codes).decode("windows-1252")
        df = df.withColumns({c: F.translate(c, low, high) for c, t in df.dtypes if t == "string"})
    return df.withColumn("doc_id", F.col("doc_id").cast("string")) if "doc_id" in df.columns else df


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, gzip or not; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON document in each file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def resolve(spark: SparkSession, run_dir: str, artifact: str) -> str:
    """The path of an artifact in a run's folder, Parquet before CSV."""
    for name in ARTIFACTS[artifact]:
        for kind in ("parquet", "csv"):
            if exists(spark, f"{run_dir}/{name}.{kind}"):
                return f"{run_dir}/{name}.{kind}"
    raise FileNotFoundError(f"no {artifact} in {run_dir}")


def read_artifact(spark: SparkSession, run_dir: str, artifact: str) -> DataFrame:
    """The artifact as a table."""
    path = resolve(spark, run_dir, artifact)
    return spark.read.parquet(path) if path.endswith(".parquet") else read_csv(spark, path)


def find_run_dir(spark: SparkSession, roots: list[str]) -> str | None:
    """The first folder that has document topics."""
    for root in roots:
        try:
            resolve(spark, root, "doc_topics")
            return root
        except FileNotFoundError:
            continue
    return None


@dataclass
class Rows(InputPartition):
    start: int
    ids: list[str]


class NpyReader(DataSourceReader):
    """Ranges of rows of an .npy matrix with a JSON list of ids beside it; each task gets its ids and reads its own bytes."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.ids = options.get("ids", re.sub(r"\.npy$", "", self.path) + "_doc_ids.json")
        self.rows = int(options.get("rows", 8192))

    def _open(self, path: str):
        fs, p = _filesystem(path)
        return fs.open_input_file(p)

    def _head(self, f) -> tuple[tuple[int, ...], np.dtype, int]:
        raw = io.BytesIO(f.read(1 << 16))
        version = np.lib.format.read_magic(raw)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, kind = read(raw)
        if fortran or len(shape) != 2:
            raise ValueError("a matrix in row order is expected")
        return shape, kind, raw.tell()

    def partitions(self) -> list[Rows]:
        with self._open(self.path) as f:
            shape, _, _ = self._head(f)
        with self._open(self.ids) as f:
            ids = [str(i) for i in json.loads(f.read())]
        if len(ids) != shape[0]:
            raise ValueError(f"{len(ids)} ids for {shape[0]} rows")
        return [Rows(i, ids[i : i + self.rows]) for i in range(0, len(ids), self.rows)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with self._open(self.path) as f:
            shape, kind, at = self._head(f)
            width = shape[1] * kind.itemsize
            f.seek(at + partition.start * width)
            x = np.frombuffer(f.read(len(partition.ids) * width), dtype=kind).reshape(-1, shape[1]).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(partition.ids), "embedding": pa.array(list(x), pa.list_(pa.float32()))})


class NpySource(DataSource):
    """``spark.read.format("npy")``: (doc_id, embedding)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "doc_id string, embedding array<float>"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, ids: str | None = None) -> DataFrame:
    """Embeddings of a matrix file and its ids."""
    spark.dataSource.register(NpySource)
    reader = spark.read.format("npy").option("path", path)
    return (reader.option("ids", ids) if ids else reader).load()


_TOKEN = re.compile(r'#[^\n]*|<([^>]*)>|"""(.*?)"""(?:@([\w-]+)|\^\^\S+)?|"((?:[^"\\]|\\.)*)"(?:@([\w-]+)|\^\^\S+)?|(@prefix|@base|PREFIX)|([;,.])(?=\s|$|<|")|([^\s;,"<]+)', re.DOTALL)


def parse_turtle(text: str) -> list[tuple[str, str, str, str | None]]:
    """(s, p, o, lang) of the statements of a Turtle document without blank nodes or lists."""
    prefixes: dict[str, str] = {}
    out, part, skip = [], [], []

    def full(name: str) -> str:
        if name.endswith(".") and not name.startswith("http"):
            name = name[:-1]
        head, colon, tail = name.partition(":")
        return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type" if name == "a" else prefixes.get(head, head + ":") + tail if colon else name

    def keep() -> None:
        if len(part) == 3:
            out.append((part[0][0], part[1][0], part[2][0], part[2][1]))

    for m in _TOKEN.finditer(text):
        uri, long, long_lang, short, short_lang, directive, mark, name = m.groups()
        if m[0].startswith("#"):
            continue
        if directive:
            skip = [directive]
        elif skip:
            skip.append(uri if uri is not None else (name or ""))
            if uri is not None:
                prefixes[skip[1].rstrip(":") if len(skip) > 2 else ""] = uri
                skip = []
        elif mark:
            keep()
            part = part[:2] if mark == "," else part[:1] if mark == ";" else []
        elif uri is not None:
            part.append((uri, None))
        elif long is not None or short is not None:
            value = long if long is not None else re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t"}.get(e[1], e[1]), short)
            part.append((value, long_lang or short_lang))
        elif name:
            part.append((full(name), None))
            if name.endswith(".") and len(part) == 3:
                keep()
                part = []
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, lang) of Turtle files, one task for each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([t for text in pdf["value"] for t in parse_turtle(text)], columns=["s", "p", "o", "lang"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "s string, p string, o string, lang string")


def cached(spark: SparkSession, path: str, key: str, make) -> DataFrame:
    """The table at path if it was made for the same key, else made and written anew."""
    mark = f"{path}/key={re.sub(r'[^A-Za-z0-9._-]', '_', key)}"
    if not exists(spark, mark):
        make().write.mode("overwrite").parquet(mark)
    return spark.read.parquet(mark)


def write_csv(df: DataFrame, path: str) -> None:
    """K1: one CSV file with a header, for tables of a report's size; Parquet is the form for the rest."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """K2: gzip JSON lines."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """K5: a JSON document of one row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """K3: (doc_id, embedding) as Parquet, ids beside their vectors."""
    df.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def write_label_index(df: DataFrame, path: str) -> None:
    """K4: (uri, text, ambiguous, embedding) as Parquet."""
    df.select("uri", "text", "ambiguous", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def align_vectors(docs: DataFrame, vectors: DataFrame | None, encode) -> DataFrame:
    """(doc_id, embedding) of every row of docs (doc_id, text): from vectors (doc_id, embedding) by id, or ``encode(docs)`` for those that have none."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    if vectors is None:
        return encode(docs).select("doc_id", "embedding")
    vectors = vectors.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    missing = docs.join(vectors.where("embedding is not null").select("doc_id"), "doc_id", "left_anti")
    kept = docs.select("doc_id").join(vectors.where("embedding is not null"), "doc_id")
    return kept if missing.isEmpty() else kept.union(encode(missing).select("doc_id", F.col("embedding").cast("array<float>")))
