"""Incremental ingest: new files of a folder are probed as they come, and the store takes each batch once.

The store is a folder of one Parquet folder a batch, named by the batch's number and written with overwrite, so a batch
that runs again after a failure replaces itself. Of a path the latest batch counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import media


def stream(spark: SparkSession, root: str, store: str, checkpoint: str, files_a_batch: int = 1000):
    """Starts a query that takes what is there in bounded batches and ends; started again, it takes what came since."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(root)
    named = files.where(~F.col("path").rlike(r"/\.[^/]")).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"))

    def put(batch: DataFrame, number: int) -> None:
        stamps = batch.select("path", "size", "modified")
        media.probe(stamps).join(stamps, "path").write.mode("overwrite").parquet(f"{store}/batch={number}")

    return named.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, store: str) -> DataFrame:
    """The store's rows, of each path the last."""
    rows = spark.read.parquet(store)
    newest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["path", "batch"]).drop("batch")
