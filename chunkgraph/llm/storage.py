"""The shared folder of intermediate tables, and how input is dealt to tasks."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch, shared_dir
from ..sources.readers import spread

__all__ = ["Scratch", "batches_of_texts", "buckets_for", "partitions", "plan_bytes", "release", "shared_dir", "spread"]


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more, once their result is written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plan_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of a plan: that of the files for a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, per: int = 128 << 20) -> int:
    """The number of buckets that rows of df are dealt to: the session's shuffle partitions, more if the input is
    larger than ``per`` bytes a bucket, so that a bucket's size doesn't grow with the input."""
    size = plan_bytes(df)
    known = size < 1 << 60  # plans without statistics report a size beyond any table
    return max(partitions(df.sparkSession), -(-size // per) if known else 1)


#: Rows of a batch that goes to a Python worker: texts are long, and both sides hold whole batches.
BATCH_ROWS = 2048


def batches_of_texts(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ``BATCH_ROWS``, unless it has been set to fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
