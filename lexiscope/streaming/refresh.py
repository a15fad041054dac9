"""Keeping token and sentence counts of a growing folder of documents up to date with Structured Streaming.

Counts are sums, so each micro-batch aggregates its own documents and appends partial rows to a ledger; the
current profile is a sum over the ledger.  A batch that is repeated after a failure overwrites its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscope.functions.text import sentences, tokens

PROFILE = ("documents", "chars", "sentences", "tokens")


def profile(docs: DataFrame) -> DataFrame:
    """``(source, documents, chars, sentences, tokens)`` of ``docs(source, text)``."""
    text = F.col("text")
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("chars"), F.sum(F.size(sentences(text))).cast("long").alias("sentences"), F.sum(F.size(tokens(text))).cast("long").alias("tokens")
    )


def refresh(spark: SparkSession, folder: str, schema: str, ledger: str, checkpoint: str):
    """Start (and return) a query that reads all new Parquet files in ``folder`` and stops when it has."""
    stream = spark.readStream.schema(schema).parquet(folder)

    def add(batch: DataFrame, number: int) -> None:
        profile(batch).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.parquet(ledger).groupBy("source").agg(*(F.sum(c).alias(c) for c in PROFILE))


def windowed_events(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``(start, event_type, n, total)`` per tumbling window of ``events(ts, event_type, value)``; works on a
    stream, where rows later than ``late`` are left out, and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
