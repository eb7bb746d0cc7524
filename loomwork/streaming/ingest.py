"""Streams into a chunk store, and failure rates on streams of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import ChunkStore


def upsert_stream(chunks: DataFrame, store: ChunkStore, checkpoint: str, order: str | None = None) -> DataStreamWriter:
    """Each micro-batch is upserted by key; replaying a batch after a failure changes nothing."""
    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.upsert(batch, order))


def failure_rates(attempts: DataFrame, time: str, failed: str, window: str = "10 minutes", late: str = "30 minutes", limit: float = 0.05) -> DataFrame:
    """Attempts and failure rate of each time window, with a watermark for late rows; works on batches
    and streams alike."""
    per = attempts.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("attempts"), F.avg(F.col(failed).cast("double")).alias("failure_rate"))
    return per.select(F.col("window.start").alias("start"), "attempts", "failure_rate", (F.col("failure_rate") > limit).alias("stop"))
