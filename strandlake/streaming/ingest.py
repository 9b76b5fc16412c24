"""Streaming ingest: new read files extend the k-mer index, and sessions of events by gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reads import kmers


def index_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, k: int = 13, step: int = 10) -> StreamingQuery:
    """Parquet files of reads (read_id, seq, len) that arrive in ``folder`` are appended to the index at ``target``.

    A batch writes its own folder, named by its number, so a batch that is run again replaces what it wrote.
    """
    reads = spark.readStream.schema("read_id long, seq string, len int").parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        kmers(batch, k, step).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions per user that end after ``gap`` without events; rows later than ``late`` are dropped by the watermark."""
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("events")).select("user_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "events")
