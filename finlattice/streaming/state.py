"""Streams with state of their own: the rate gate, and predictions that wait for their outcomes.

The rate gate judges a key's runs in time order although they arrive in any: a run waits in the key's
state until the watermark is past its time, when no earlier one can come any more.  What is left of
a judged run is the time of the last one let through and the day's count; a timer clears that when
neither can matter again, so keys that fall silent cost nothing.  Both survive restarts with the
query's checkpoint.  Rows behind the watermark are dropped and counted in the query's progress.

Needs the RocksDB state store (`with_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000
#: A run as state and pandas hold it: its other columns as JSON, so that nulls stay what they are.
RUN = "row string, micros long, tie long"
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Gate(StatefulProcessor):
    """Lets a run through `gap` microseconds after the last one it let through, `a_day` of a day at most."""

    def __init__(self, gap: int, a_day: int):
        self.gap, self.a_day = gap, a_day

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "time long, day long, n int")
        self.waiting = handle.getListState("waiting", RUN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = [run for batch in rows for run in zip(batch["row"].tolist(), batch["micros"].tolist(), batch["tie"].tolist(), strict=True)]
        if runs:  # in one call: each call on the state is a message to the JVM and back
            self.waiting.appendList(runs)
            self.handle.registerTimer(min(time for _, time, _ in runs) // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get())
        ripe = sorted((w for w in waiting if w[-2] // 1000 <= watermark), key=lambda w: (w[-2], w[-1]))
        later = [tuple(w) for w in waiting if w[-2] // 1000 > watermark]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(w[-2] for w in later) // 1000)
        else:
            self.waiting.clear()
        state, let = (tuple(self.last.get()) if self.last.exists() else None), []
        for w in ripe:
            time, day = w[-2], w[-2] // DAY
            today = state[2] if state and state[1] == day else 0
            if (state is None or time - state[0] >= self.gap) and today < self.a_day:
                state = time, day, today + 1
                let.append(tuple(w))
        if state is not None:
            matters = max(state[0] + self.gap, (state[1] + 1) * DAY) // 1000 + 1
            if let:
                self.last.update(state)
                self.handle.registerTimer(matters)
            elif not later and watermark >= matters:
                self.last.clear()
        yield pd.DataFrame(let, columns=["row", "micros", "tie"]) if let else pd.DataFrame()

    def close(self) -> None:
        pass


def gate_stream(runs: DataFrame, key: str, ts: str = "ts", hours: float = 4.0, a_day: int = 4, late: str = "1 hour") -> DataFrame:
    """The runs of a stream that monitoring.gap_allowed() lets through, each when the watermark is past it; days are those of UTC.

    Of runs at the same time the one with the smallest hash of its columns is first.
    """
    with_state_store(runs.sparkSession)
    names = runs.columns
    rows = runs.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    others = F.struct(F.lit(True).alias("kept"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(names) if c != ts])
    run = rows.select(F.xxhash64(key).alias("gate"), ts, F.to_json(others, JSON).alias("row"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), F.xxhash64(*names).alias("tie"))
    run = run.select("gate", F.col(ts).alias("at"), "row", "micros", "tie")
    stated = run.groupBy("gate").transformWithStateInPandas(Gate(int(hours * 3_600_000_000), a_day), RUN, "Append", "EventTime")
    kind = ", ".join(["kept boolean", *[f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(runs.schema) if f.name != ts]])
    back = stated.select("micros", F.from_json("row", kind, JSON).alias("r"))
    return back.select(*[F.timestamp_micros("micros").alias(c) if c == ts else F.col("r")[f"c{i}"].alias(c) for i, c in enumerate(names)])


def met_outcomes(predictions: DataFrame, outcomes: DataFrame, days: int = 30, late: str = "1 day", how: str = "inner", key: str = "symbol", day: str = "predict_date") -> DataFrame:
    """Two streams joined on key and day, where the outcome comes 0 to `days` days after the prediction.

    predictions: (key, day, made_at, ..); outcomes: (key, day, known_at, ..).  Both sides wait in state
    until the other's watermark is past the interval; with how="leftOuter" a prediction without an
    outcome is given out then, with nulls.
    """
    left = predictions.withWatermark("made_at", late).alias("p")
    right = outcomes.withWatermark("known_at", late).alias("o")
    same = F.col(f"p.{key}").eqNullSafe(F.col(f"o.{key}")) & (F.col(f"p.{day}") == F.col(f"o.{day}"))
    soon = (F.col("o.known_at") >= F.col("p.made_at")) & (F.col("o.known_at") <= F.col("p.made_at") + F.expr(f"INTERVAL {days} DAYS"))
    joined = left.join(right, same & soon, how)
    return joined.select("p.*", *[f"o.{c}" for c in outcomes.columns if c not in (key, day)])


def append_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All there is, appended to Parquet files once, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came behind the watermark, by the query's progress so far."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
