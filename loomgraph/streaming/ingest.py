"""Structured Streaming ingest of links (an extension: the batch model has no streams).

``running_support`` keeps distinct (chunk, term) counts of an unbounded stream;
``sessions`` groups an entity's mentions into sessions; both bound their state by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_support(links: DataFrame, lateness: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Stream ``links(chunk_id, term_id, ts)`` to distinct chunks per term and window; late and repeated links don't count."""
    once = links.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["chunk_id", "term_id"])
    return once.groupBy(F.window("ts", window), "term_id").agg(F.count("*").alias("n_chunks")).select(F.col("window.start").alias("start"), "term_id", "n_chunks")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Stream ``events(user_id, ts, ...)`` to sessions closed by a gap."""
    s = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n_events")


def upsert_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch under its own epoch folder; a repeated epoch overwrites itself, so output is exactly once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
