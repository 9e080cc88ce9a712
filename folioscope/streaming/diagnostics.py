"""Diagnostic events: redaction, the bounded log, latency windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import fixed, text as tx


def redact_text(text: Column) -> Column:
    hidden = F.regexp_replace(F.coalesce(text, F.lit("")), fixed.BEARER_PATTERN,
                              f"Bearer {fixed.REDACTED}")
    return tx.clip(F.regexp_replace(hidden, fixed.API_KEY_PATTERN, f"$1={fixed.REDACTED}"),
                   500, "…")


def is_sensitive_key(key: Column) -> Column:
    low = F.lower(key)
    hit = F.lit(False)
    for part in fixed.SENSITIVE_ATTRIBUTE_PARTS:
        hit = hit | F.contains(low, F.lit(part))
    return hit


def redact(events: DataFrame) -> DataFrame:
    """Events (ts, type, category, message, attributes) without secrets. Works on streams."""
    entries = F.transform(F.map_entries(F.coalesce(
        F.col("attributes"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(
        redact_text(e["key"]).alias("key"),
        F.when(is_sensitive_key(e["key"]), fixed.REDACTED).otherwise(redact_text(e["value"]))
        .alias("value")))
    return (events.withColumn("type", redact_text(F.col("type")))
            .withColumn("category", redact_text(F.col("category")))
            .withColumn("message", redact_text(F.col("message")))
            .withColumn("attributes", F.map_from_entries(entries)))


def latest_events(events: DataFrame, capacity: int = 300) -> DataFrame:
    """The newest events, by (ts, event_id): a distributed top-k, never below twenty."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(20, capacity))


def latency_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling windows per category and outcome (ts, category, outcome, latency_ms)."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return (events.groupBy(F.window("ts", width).alias("w"), "category", "outcome")
            .agg(F.count("*").alias("calls"), F.avg("latency_ms").alias("mean_ms"),
                 F.max("latency_ms").alias("max_ms"))
            .select(F.col("w.start").alias("window_start"), "category", "outcome", "calls",
                    "mean_ms", "max_ms"))


def bounded_log(events: DataFrame, folder: str, checkpoint: str, capacity: int = 300):
    """Streams redacted events into a log of the newest ones, rewritten per micro-batch under a
    new name so that a retried batch gives the same result."""
    spark = events.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch
        if number > 0:
            rows = spark.read.parquet(f"{folder}/batch={number - 1}").unionByName(batch)
        latest_events(rows, capacity).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (redact(events).writeStream.foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
