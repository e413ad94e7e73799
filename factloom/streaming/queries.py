"""Streaming forms of the telemetry operators.

The batch forms are the reference semantics; a stream drops what arrives later than its watermark and
keeps a window open until the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import facts as O
from ..sources.tables import table


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", schema: str | None = None) -> DataFrame:
    """Event files as a stream; ts becomes a timestamp, which watermarks need."""
    kind = schema or spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = spark.readStream.schema(kind).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Debounced bursts: a session is emitted once no event can extend it."""
    return O.sessions(events.withWatermark("ts", late), key, "ts", gap)


def runtime_edges(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Running aggregate of (user_id, event_type); for update or complete mode."""
    return O.runtime_edges(events.withWatermark("ts", late), "user_id", "event_type", "value", "ts")


def unique_spans(spans: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each span once, however often it is delivered within the watermark."""
    return spans.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def linked(events: DataFrame, producer: str = "click", consumer: str = "purchase", within: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Producer and consumer events of a user at most ``within`` apart, also across micro-batches."""
    p = events.where(F.col("event_type") == producer).select(F.col("event_id").alias("producer"), F.col("user_id").alias("pu"), F.col("ts").alias("pts")).withWatermark("pts", late)
    c = events.where(F.col("event_type") == consumer).select(F.col("event_id").alias("consumer"), F.col("user_id").alias("cu"), F.col("ts").alias("cts")).withWatermark("cts", late)
    joined = p.join(c, F.expr(f"pu = cu and cts >= pts and cts <= pts + interval {within}"))
    return joined.select("producer", "consumer", "cu", (F.unix_millis("cts") - F.unix_millis("pts")).alias("latency_ms"))


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that is there now, to parquet, exactly once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert(df: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Updated rows of each micro-batch to merge(rows, batch number); merge must be idempotent for a number."""
    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def batch_linked(spark: SparkSession, sf_dir: str, within: str = "30 minutes") -> DataFrame:
    """The same pairs in batch: time buckets make an equi-join of the range join."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    width = f"interval {within}"
    at = lambda c: F.window(c, within)["start"]
    p = e.where("event_type = 'click'").select(F.col("event_id").alias("producer"), "user_id", F.col("ts").alias("pts")).withColumn("slot", F.explode(F.array(at("pts"), at("pts") + F.expr(width))))
    c = e.where("event_type = 'purchase'").select(F.col("event_id").alias("consumer"), "user_id", F.col("ts").alias("cts")).withColumn("slot", at("cts"))
    return p.join(c, ["user_id", "slot"]).where(F.expr(f"cts >= pts and cts <= pts + {width}")).select("producer", "consumer", "user_id")
