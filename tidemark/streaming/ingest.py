"""Deliveries that arrive as files, taken in as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.snapshots import snapshot_changes
from tidemark.session import scratch


def ingest(spark: SparkSession, source: str, store: str, progress: str) -> None:
    """Append the files of ``source`` not yet taken in to the table at ``store``, each exactly once.

    ``progress`` remembers what was taken in; a run that broke off goes on from there. Ends when no file is left.
    ``source`` is a folder, or one file of it.
    """
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        reader, source = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    stream = reader.parquet(source)
    query = stream.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(store)
    query.awaitTermination()


def changes_once(spark: SparkSession, source: str) -> DataFrame:
    """Changes between the full snapshots found in a folder of deliveries, taken in as a stream."""
    base = scratch(spark, "stream")
    ingest(spark, source, f"{base}/store", f"{base}/progress")
    return snapshot_changes(spark.read.parquet(f"{base}/store"))
