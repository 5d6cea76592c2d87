"""Incremental ingest of a folder; beyond batch use. No state store: the node table is the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import ingest


def watch_folder(spark: SparkSession, source: str, target: str, checkpoint: str, interval: str | None = None, size: int = 512, overlap: int = 50) -> StreamingQuery:
    """Chunks new text files of ``source`` into Parquet at ``target``; the trigger is the checkpoint policy.

    A batch writes its own folder again if it is repeated, so a retry adds nothing twice."""
    files = spark.readStream.option("wholetext", True).format("text").load(source).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest(batch, size, overlap).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
