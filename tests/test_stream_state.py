"""Streams with state against their batch twins, across restarts and late rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from finlattice.operators import monitoring
from finlattice.streaming import state

START = datetime.datetime(2024, 1, 1)
RUNS = "k string, i int, ts timestamp, note string, amount double"


def minutes(m):
    return START + datetime.timedelta(minutes=m)


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_gate_across_restarts(spark, tmp_path):
    """Runs in any order within a day, over three starts of the query; what was late is counted and left out."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, minutes(r.randint(0, 20 * 1440)), None if i % 4 else f"n{i}", None if i % 3 else i / 7) for i in range(600)]
    rows.sort(key=lambda x: x[2])
    parts = [rows[:200], rows[200:400], rows[400:]]
    for p in parts:
        r.shuffle(p)
    dropped = 0
    for i, part in enumerate([*parts, [("late", -1, minutes(5), None, None)], [("end", -2, minutes(10_000_000), None, None)]]):
        add(spark, folder, part, RUNS)
        stream = spark.readStream.schema(RUNS).parquet(folder)
        q = state.append_files(state.gate_stream(stream, "k", late="1 day"), out, checkpoint)
        q.awaitTermination()
        dropped += state.dropped_late(q)
    got = spark.read.schema(RUNS).parquet(out)
    assert got.columns == ["k", "i", "ts", "note", "amount"] and dropped >= 1
    found = sorted(map(tuple, got.where("i >= 0").collect()), key=str)
    want = sorted(map(tuple, monitoring.gap_allowed(spark.createDataFrame(rows, RUNS), key="k").collect()), key=str)
    assert found == want and got.where("k = 'late'").count() == 0


PREDICTED, KNOWN = "symbol string, predict_date date, made_at timestamp, p double", "symbol string, predict_date date, known_at timestamp, end double"


@pytest.mark.parametrize("how", ["inner", "leftOuter"])
def test_outcomes_of_two_streams(spark, tmp_path, how):
    day = lambda d: START + datetime.timedelta(days=d)
    predicted = [(s, day(d).date(), day(d), float(d)) for s in ("x", "y", None) for d in range(40)]
    known = [(s, day(d).date(), day(d + wait), d / 2) for s in ("x", None) for d in range(40) for wait in [r.randint(0, 12) for r in [random.Random(d)]]]
    folders = [str(tmp_path / n) for n in ("p", "o")]
    for i in range(2):  # each side in two files and two starts
        add(spark, folders[0], predicted[i::2], PREDICTED)
        add(spark, folders[1], known[i::2], KNOWN)
        if i:
            for folder, schema in zip(folders, (PREDICTED, KNOWN), strict=True):
                add(spark, folder, [("end", day(5000).date(), day(5000), 0.0)], schema)
        streams = [spark.readStream.schema(s).parquet(f) for f, s in zip(folders, (PREDICTED, KNOWN), strict=True)]
        q = state.append_files(state.met_outcomes(*streams, days=8, late="100 days", how=how), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("symbol IS NULL OR symbol <> 'end'")
    within = {(s, d): (at, end) for s, d, at, end in known if at <= datetime.datetime.combine(d, datetime.time()) + datetime.timedelta(days=8)}
    want = [(s, d, at, p, *within.get((s, d), (None, None))) for s, d, at, p in predicted if how == "leftOuter" or (s, d) in within]
    assert 0 < len(within) < len(known) and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_state_is_cleared(spark, tmp_path):
    """Old predictions leave the state once the watermark is past their interval."""
    folders = [str(tmp_path / n) for n in ("p", "o")]
    day = lambda d: START + datetime.timedelta(days=d)
    held = []
    for first in (0, 400, 800):
        add(spark, folders[0], [("x", day(first + d).date(), day(first + d), 1.0) for d in range(100)], PREDICTED)
        add(spark, folders[1], [("y", day(first + d).date(), day(first + d), 1.0) for d in range(100)], KNOWN)
        streams = [spark.readStream.schema(s).parquet(f) for f, s in zip(folders, (PREDICTED, KNOWN), strict=True)]
        q = state.append_files(state.met_outcomes(*streams, days=5, late="1 day"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        q.awaitTermination()
        held.append(q.lastProgress.stateOperators[0].numRowsTotal)
    assert max(held) < 100 and spark.read.schema(PREDICTED).parquet(str(tmp_path / "out")).count() == 0


def test_gate_appends_a_batch_in_one_call():
    """A key's runs go to its state together: the calls don't grow with the runs."""
    import pandas as pd

    calls, timers = [], []

    class Runs:
        def appendList(self, runs):
            calls.append(runs)

        def appendValue(self, run):
            calls.append([run])

    gate = state.Gate(1, 4)
    gate.waiting = Runs()
    gate.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    batches = [pd.DataFrame({"row": [f"{i}" for i in part], "micros": [i * 1000 for i in part], "tie": [7] * len(part)}) for part in (range(500, 900), range(100, 500))]
    for out in gate.handleInputRows((1,), iter(batches), None):
        assert out.empty
    assert len(calls) == 1 and len(calls[0]) == 800 and calls[0][400] == ("100", 100_000, 7) and timers == [100]
