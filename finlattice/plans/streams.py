"""Queries of streams with state: tables laid out as files, read as streams to their end, results read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_folder
from ..streaming import state
from .inputs import BARS, bars, rounded, table
from .registry import SQL, query


def _stream(spark: SparkSession, rows: DataFrame, ts: str, name: str, files: int = 4) -> DataFrame:
    """rows as a stream of files, a file a batch, and at the end a row far later that moves the watermark past all others and so is never given out."""
    folder = scratch_folder(spark, name)
    rows.repartitionByRange(files, ts).write.parquet(folder)
    later = rows.orderBy(F.desc(ts)).limit(1).withColumn(ts, F.col(ts) + F.expr("INTERVAL 10000 DAYS"))
    later.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(folder)


def _read_back(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    base = scratch_folder(spark, name)
    state.append_files(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query(SQL["rate_gate"])
def stream_rate_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The rate gate as a stream: the rows of rate_gate."""
    events = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    gated = state.gate_stream(_stream(spark, events, "ts", "gate-runs"), "user_id", late="400 days")
    return _read_back(spark, gated, "gate").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"""WITH {BARS}, l AS (SELECT symbol, bar_date AS predict_date, open < close AS rises, close AS start_price, lead(close, 5) OVER w AS end_price, lead(bar_date, 5) OVER w AS actual_date FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))
SELECT symbol, predict_date, rises, round(CASE WHEN actual_date <= predict_date + 30 THEN end_price / start_price - 1 END, 6) + 0.0 AS actual_magnitude, CASE WHEN actual_date <= predict_date + 30 THEN actual_date END AS actual_date FROM l""")
def stream_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of one stream met by the other's closes five rows later; those that wait in vain for 30 days come out without."""
    rows = bars(spark, sf).withColumn("made_at", F.col("bar_date").cast("timestamp"))
    predicted = rows.select("symbol", F.col("bar_date").alias("predict_date"), "made_at", (F.col("open") < F.col("close")).alias("rises"), F.col("close").alias("start_price"))
    back = "LAG({}, 5) OVER (PARTITION BY symbol ORDER BY bar_date)"
    known = rows.select("symbol", F.expr(back.format("bar_date")).alias("predict_date"), F.col("made_at").alias("known_at"), F.col("close").alias("end_price")).where("predict_date IS NOT NULL")
    met = state.met_outcomes(_stream(spark, predicted, "made_at", "predictions"), _stream(spark, known, "known_at", "outcomes"), late="4000 days", how="leftOuter")
    found = _read_back(spark, met, "met")
    return rounded(found.select("symbol", "predict_date", "rises", (F.col("end_price") / F.col("start_price") - 1).alias("actual_magnitude"), F.to_date("known_at").alias("actual_date")))
