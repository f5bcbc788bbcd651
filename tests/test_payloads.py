"""The payload data source: places in turn, clamping, pruning, high-water marks."""

import json
from datetime import date

import pytest

from finlattice.sources import payloads


@pytest.fixture(scope="module")
def places(tmp_path_factory):
    a, b = (tmp_path_factory.mktemp(n) for n in "ab")
    records = [{"bar_date": f"2024-01-{d:02}", "open": d, "close": f"1,00{d}", "volume": "-"} for d in range(1, 10)]
    (a / "x.json").write_text(json.dumps([*records[::-1], {"bar_date": "20240110", "close": 5.5, "note": "é"}, {"bar_date": "2024-01-01", "close": 7}]))
    (a / "y.json").write_text("{broken")
    (b / "y.json").write_text(json.dumps(records[:3]))
    (a / "z.json").write_text(json.dumps([{"close": 1}]))  # no date
    (b / "z.json").write_text("[]")
    return f"{a};{b}"


def reader(spark, places, symbols, **options):
    spark.dataSource.register(payloads.PayloadSource)
    return spark.read.format("payloads").options(places=places, symbols=symbols, wait="0.01", **options)


def test_places_are_tried_in_turn(spark, places):
    df = reader(spark, places, "x, y,z").load()
    rows = sorted(map(tuple, df.collect()))
    assert [r[:2] for r in rows] == [("x", date(2024, 1, d)) for d in range(1, 11)] + [("y", date(2024, 1, d)) for d in range(1, 4)]
    assert rows[0][5] == 7.0 and rows[1] == ("x", date(2024, 1, 2), 2.0, None, None, 1002.0, None) and rows[9][5] == 5.5
    assert df.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="no place has nowhere"):
        reader(spark, places, "nowhere", attempts="2").load().collect()
    assert reader(spark, places, "nowhere,y", missing="skip").load().count() == 3


def test_dates_are_clamped_and_columns_pruned(spark, places):
    df = reader(spark, places, "x", start="20240103", end="2024-01-05").schema("bar_date date, close double, note string").load()
    assert [tuple(r) for r in df.collect()] == [(date(2024, 1, d), 1000.0 + d, None) for d in (3, 4, 5)]
    one = reader(spark, places, "x", start="2024-01-10").schema("symbol string, note string, bar_date date").load().first()
    assert (one.symbol, one.note) == ("x", "é")
    with pytest.raises(Exception, match="places and symbols"):
        reader(spark, "", "x").load().collect()


def test_attempts_wait(places, monkeypatch):
    waited, calls = [], []
    monkeypatch.setattr(payloads.time, "sleep", waited.append)
    schema = payloads.PayloadSource({}).schema()

    p = payloads.Payloads.__new__(payloads.Payloads)
    p.places, p.attempts, p.wait, p.skip, p.date = ["a", "b"], 3, 0.5, False, "bar_date"

    def fetch(place, symbol):
        calls.append(place)
        if len(calls) < 5:
            raise OSError("busy")
        return {"2024-01-01": {}}

    p._fetch = fetch
    assert p.records("x") == {"2024-01-01": {}} and calls == ["a"] * 3 + ["b"] * 2 and waited == [0.5, 1.0, 0.5] and schema == payloads.BARS


def test_a_stream_goes_on_from_its_high_water_marks(spark, tmp_path):
    spark.dataSource.register(payloads.PayloadSource)
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    folder.mkdir()
    for last in (3, 3, 7):
        for s in ("x", "y"):
            (folder / f"{s}.json").write_text(json.dumps([{"bar_date": f"2024-01-{d:02}", "close": d} for d in range(1, last + (s == "y"))]))
        stream = spark.readStream.format("payloads").options(places=str(folder), symbols="x,y").schema("symbol string, bar_date date, close double").load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        q.processAllAvailable()
        q.stop()
    got = spark.read.schema("symbol string, bar_date date, close double").parquet(out)
    assert sorted((r.symbol, r.bar_date.day) for r in got.collect()) == [("x", d) for d in range(1, 7)] + [("y", d) for d in range(1, 8)]
