"""Event streams: parsing, deduplication, windowed counts, and idempotent sinks.

Offsets and acknowledgement are the query's checkpoint; a batch that is replayed after a failure
changes nothing because sinks are keyed upserts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, names: str = "*", schema: str = EVENTS, files_a_batch: int | None = None) -> DataFrame:
    """The Parquet files of a folder as a stream, with ts as a timestamp that watermarks accept."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", names)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_a_batch))
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def parsed(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))


def once(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, as far back as the watermark."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def window_counts(df: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = "1 hour") -> DataFrame:
    """Counts and sums by event type and tumbling or sliding window; late: None if df has a watermark."""
    rows = df.withWatermark("ts", late) if df.isStreaming and late else df
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = df.withWatermark("ts", late) if df.isStreaming else df
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def run_batches(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Everything there is, in micro-batches, then stop; handle must be idempotent for a batch number."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_sink(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch under its own number, replacing an earlier attempt; latest() reads it."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return handle


def latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The rows of upsert_sink, the last batch of each key counting."""
    rows = spark.read.schema(f"{schema}, _batch long").parquet(f"{path}/batch=*")
    rest = [c for c in rows.columns if c not in (*keys, "_batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("_batch")).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def classify_and_upsert(df: DataFrame, checkpoint: str, path: str, classify: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """A stream of crawled news: each micro-batch is classified and put in by key, then its offsets are committed."""
    sink = upsert_sink(path, keys)
    return run_batches(df, checkpoint, lambda batch, number: sink(classify(batch), number))
