"""Tables that cut lineage, written where every executor can read them.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session
without that setting (a test) gets a temporary folder of its own. What an operator's result
may still read stays until the driver's process ends, which deletes it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder as a URI; a temporary one where none is set and executors share the driver's machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and spark.sparkContext.getCheckpointDir() is not None:
        named = spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="trendloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        delete(spark, path)


class Scratch:
    """A folder for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/trendloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(_delete_at_exit, spark, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes df and returns it read back, without its lineage."""
        path, schema = self.path(name), df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._trendloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that save() returned and that nothing reads any more."""
        path = getattr(df, "_trendloom_path", None)
        if path is not None:
            delete(self.spark, path)
