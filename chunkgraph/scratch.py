"""Tables written to the shared checkpoint folder, to cut lineage so that a lost executor costs a re-read only."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only on one machine, where the session names no shared folder.
DEFAULT_DIR = "file:///tmp/checkpoints/chunkgraph"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; the default above on a local master alone, which shares every folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return DEFAULT_DIR


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """A folder of intermediate tables of one operator call.

    ``write`` runs the plan once and returns a frame that reads the written Parquet. ``drop`` deletes tables that
    nothing reads any more, ``close`` all of them; what a returned frame still reads is deleted as the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, label: str) -> DataFrame:
        df.write.mode("errorifexists").parquet(f"{self.path}/{label}")
        return self.read(label, df.schema)

    def read(self, label: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{label}")

    def drop(self, *labels: str) -> None:
        for label in labels:
            delete(self.spark, f"{self.path}/{label}")

    def close(self) -> None:
        try:
            delete(self.spark, self.path)
        except Exception:  # the session may be gone by now
            pass
        atexit.unregister(self.close)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()
