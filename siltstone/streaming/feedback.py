"""Streams: merging labelled feedback batch by batch, and windowed counts with late rows dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.dedupe import merge_feedback


def feedback_stream(stream: DataFrame, table: str, conflicts: str, key: str, label: str, order: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new keys to a Parquet table and its conflicting rows to another; rerun batches add nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        existing = spark.read.schema(batch.schema).parquet(table)
        merged = merge_feedback(existing, batch, key, label, order).persist()
        merged.where("outcome = 'added'").drop("outcome").write.mode("append").parquet(table)
        merged.where("outcome = 'conflict'").drop("outcome").write.mode("append").parquet(conflicts)
        merged.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean of each kind in tumbling windows (for batches and streams)."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value")).select(F.col("window.start").alias("window_start"), kind, "n", "mean_value")
