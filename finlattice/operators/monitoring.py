"""Accuracy roll-ups, decay, alerts, training triggers and the deploy gate."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import divide, last_business_day
from ..scratch import unused


def accuracy_status(records: DataFrame, recent: int = 20, key: str = "symbol", date: str = "predict_date") -> DataFrame:
    """One row a key: MAE, RMSE, direction accuracy, and the mean error of the last `recent` rows."""
    rows = records.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date))))
    e = F.col("error_magnitude")
    return rows.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(e).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.col("direction_correct").cast("double")).alias("direction_accuracy"),
        F.avg(F.when(F.col("_back") <= recent, e)).alias("recent_mae"),
        F.min(F.when(F.col("_back") <= 5, e)).alias("_least_of_5"),
        F.max(date).alias("last_date"),
    )


def decay(status: DataFrame, factor: float = 1.5) -> DataFrame:
    return status.withColumn("decayed", F.col("recent_mae") > factor * F.col("mae"))


def alerts(status: DataFrame, runs: DataFrame, failures: DataFrame, as_of: str, factor: float = 1.5, most_days: int = 30, least_accuracy: float | None = 0.5, most_failures: int = 3, key: str = "symbol") -> DataFrame:
    """(key, alert): decay, stale training, low accuracy, five errors in a row, repeated failures.

    runs: (key, trained_at); failures: (key).
    """
    last_run = runs.groupBy(key).agg(F.max(F.to_date("trained_at")).alias("_trained"))
    failed = failures.groupBy(key).agg(F.count("*").alias("_failed"))
    rows = status.join(last_run, key, "left").join(failed, key, "left")
    today = F.lit(as_of).cast("date")
    rules: dict[str, Column] = {
        "performance_decay": F.col("recent_mae") > factor * F.col("mae"),
        "stale_model": F.coalesce(F.datediff(today, "_trained") >= most_days, F.lit(True)),
        "low_accuracy": (F.col("direction_accuracy") < least_accuracy) if least_accuracy is not None else F.lit(False),
        "consecutive_errors": (F.col("n") >= 5) & (F.col("_least_of_5") > factor * F.col("mae")),
        "training_failures": F.coalesce(F.col("_failed") >= most_failures, F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(key, F.explode(found).alias("alert"))


def triggers(days: DataFrame, date: str = "day", decayed: Column | None = None) -> DataFrame:
    """Which retraining is due on a day: weekly on Friday, monthly and quarterly on the last weekday, or decay."""
    d = F.col(date)
    return days.withColumns({"weekly": F.weekday(d) == 4, "monthly": last_business_day(d), "quarterly": last_business_day(d, quarter=True), "decay": decayed if decayed is not None else F.lit(False)})


def should_deploy(new_f1: Column, old_f1: Column, new_mse: Column, old_mse: Column, least_gain: float = 0.05, most_ratio: float = 0.9) -> Column:
    """A new model goes live if F1 gains enough or MSE falls enough, or there is no old one."""
    return F.coalesce((new_f1 - old_f1 >= least_gain) | (new_mse <= most_ratio * old_mse), F.lit(True))


def model_health(runs: DataFrame, as_of: str, most_days: int = 30, key: str = "symbol") -> DataFrame:
    last = runs.groupBy(key).agg(F.max(F.to_date("trained_at")).alias("last_trained"))
    age = F.datediff(F.lit(as_of).cast("date"), "last_trained")
    return last.withColumn("age_days", age).withColumn("status", F.when(F.col("age_days") >= most_days, "stale").otherwise("fresh"))


def gap_allowed(runs: DataFrame, ts: str = "ts", hours: float = 4.0, a_day: int = 4, key: str | None = None) -> DataFrame:
    """Runs that the rate gate lets through: `hours` after the last one it let through, at most `a_day` of a day.

    A gate's runs are taken in turn, each in view of those before it: a key's runs pass through one task
    in time order, with the last run and the day's count as the only state, so neither memory nor a
    step's work grows with their number.  Runs at the same time count one by one; those without a time
    are held back.
    """
    by = [key] if key else []
    own = unused(runs, "_gate")
    at = {f"{own}_key": F.xxhash64(*by) if by else F.lit(0).cast("long"), f"{own}_time": F.unix_micros(F.col(ts).cast("timestamp")), f"{own}_day": F.unix_date(F.to_date(F.col(ts).cast("timestamp"))), f"{own}_same": F.xxhash64(*[c for c, kind in runs.dtypes if not kind.startswith("map")])}
    gap, width = int(hours * 3_600_000_000), len(runs.columns)

    def gate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, day, count = object(), 0, None, 0
        for batch in batches:
            keys = batch.column(width).to_pylist() if not by else list(zip(batch.column(width).to_pylist(), batch.column(batch.schema.get_field_index(key)).to_pylist(), strict=True))
            let = []
            for k, t, d in zip(keys, batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True):
                if k != held:
                    held, last, day, count = k, -gap - (1 << 62), None, 0
                today = count if d == day else 0
                through = t - last >= gap and today < a_day
                if through:
                    last, day, count = t, d, today + 1
                let.append(through)
            yield pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width]).filter(pa.array(let, pa.bool_()))

    rows = runs.where(F.col(ts).isNotNull()).withColumns(at)
    rows = (rows.repartition(f"{own}_key") if by else rows.coalesce(1)).sortWithinPartitions(f"{own}_key", *by, f"{own}_time", f"{own}_same")
    return rows.mapInArrow(gate, runs.schema)


def fallback_prediction(df: DataFrame, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """The rule for keys without a model: RSI bounds, else MACD's sign; size from recent volatility.

    df: (key, date, rsi_14, macd_hist, vol20 as the daily deviation of returns); the last row of each key decides.
    """
    last = df.groupBy(key).agg(F.max_by(F.struct("rsi_14", "macd_hist", "vol20"), date).alias("s"), F.max(date).alias("predict_date"))
    rsi, hist = F.col("s.rsi_14"), F.col("s.macd_hist")
    up = F.when(rsi < 35, True).when(rsi > 65, False).otherwise(F.coalesce(hist > 0, F.lit(False)))
    size = F.least(F.coalesce(F.col("s.vol20"), F.lit(0.0)) * F.sqrt(F.lit(5.0)), F.lit(0.15))
    return last.select(key, "predict_date", up.cast("int").alias("direction"), F.when(up, size).otherwise(-size).alias("magnitude"), F.lit("technical").alias("source"))


def trend_prediction(df: DataFrame, price: str = "close", points: int = 5, band: float = 0.02, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """Up, down or flat by the move over the last `points` rows against a band of 2 %."""
    back = df.withColumn("_back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))).where(F.col("_back") <= points)
    ends = back.groupBy(key).agg(divide(F.max_by(price, date), F.min_by(price, date)).alias("_r"), F.max(date).alias("predict_date"))
    move = F.col("_r") - 1
    return ends.select(key, "predict_date", move.alias("move"), F.when(move > band, "up").when(move < -band, "down").otherwise("flat").alias("trend"))
