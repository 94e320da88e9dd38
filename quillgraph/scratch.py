"""Tables that cut lineage, in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; set here only where the cluster names none, in local runs."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillgraph-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found else f"file://{os.path.abspath(found)}"


def grown(df: DataFrame) -> DataFrame:
    """One side of a join that must not be broadcast: it grows with the corpus, and a broadcast goes through the driver."""
    return df.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder of its own below the shared one; what is left of it goes when Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:04d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(where := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch_path = where
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Deletes saved tables that nothing will read again."""
        for df in frames:
            delete(self.spark, df._scratch_path)

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
