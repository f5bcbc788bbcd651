"""The keyed store: what is rewritten, replays, killed writers, odd keys."""

import random

import pytest

from finlattice.sources import sinks, store

SCHEMA = "k long, day date, v string, n int"


@pytest.fixture
def held(spark, tmp_path):
    from datetime import date

    rows = [(k, date(2020, 1 + k % 12, 1 + k % 28), f"v{k}", k) for k in range(240)] + [(None, None, "none", 0)]
    return store.create(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "s"), ["k", "day"], bucket_by=["k"], date="day", buckets=5)


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_batch_rewrites_its_cells_only(spark, held):
    before, files = held.cells(), set(held.rows().inputFiles())
    assert len(before) == len({(c, f) for c, f in before.items()}) and len(files) >= len(before)
    one = spark.createDataFrame([(7, None, "new", 1)], SCHEMA).selectExpr("k", "DATE '2020-08-08' AS day", "v", "n")
    assert held.upsert("b", one)
    after = held.cells()
    changed = {c for c in after if after[c] != before.get(c)}
    assert changed == held._cells_of(one) and len(changed) == 1 and before.keys() == after.keys()
    assert len(files - set(held.rows().inputFiles())) == 1  # the one file of that cell
    assert held.rows().where("v = 'new'").count() == 1 and held.rows().count() == 241
    read = held.rows_of(one)
    assert {r.v for r in read.collect()} == {"new"} and 0 < len(read.inputFiles()) < len(files)
    assert len(held.rows_between("2020-03-02", "2020-03-31").inputFiles()) <= 5


def test_replays_change_nothing(spark, held):
    rows = held.rows().limit(20).selectExpr("k", "day", "'x' AS v", "n + 1 AS n")
    rows = spark.createDataFrame(rows.collect(), SCHEMA)
    assert held.upsert("b", rows)
    once, commits = content(held.rows()), held.commits()
    assert not held.upsert("b", rows) and not held.delete("b", rows)
    assert content(held.rows()) == once and held.commits() == commits


@pytest.mark.parametrize("step", ["_write", "_publish"])
def test_a_killed_writer_leaves_the_old_version(spark, held, monkeypatch, step):
    old, whole = content(held.rows()), getattr(store.KeyedStore, step)

    def dies(self, *args):
        whole(self, *args) if step == "_write" else self.spark.createDataFrame([(1, "x", "y")], store.MANIFEST).write.parquet(f"{self.path}/manifests/{args[2]}")
        raise RuntimeError("killed")

    new = spark.createDataFrame([(1, None, "late", 1)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(store.KeyedStore, step, dies)
        with pytest.raises(RuntimeError):
            held.upsert("b", new)
    again = store.open_store(spark, held.path)
    assert content(again.rows()) == old
    assert again.upsert("b", new) and again.rows().where("v = 'late'").count() == 1
    assert again.vacuum(1) >= 1 and again.rows().count() == len(old) + 1


def test_readers_keep_their_version(spark, held):
    old, first = content(held.rows()), held.rows()
    held.delete("gone", held.rows().select("k", "day"))
    assert content(first) == old == content(held.rows(0)) and held.rows().count() == 0
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):  # a second writer that began from the same version
        held._publish(1, "other", "f", {})


def test_changes_are_those_of_the_operators(spark, held):
    r = random.Random(3)
    stored = held.rows().collect()
    for i in range(3):
        base = spark.createDataFrame(stored, SCHEMA)
        picked = r.sample(stored, 30)
        batch = spark.createDataFrame([(x.k, x.day, None if j % 3 else f"b{i}", x.n + 1000) for j, x in enumerate(picked)] + [(1000 + 10 * i + j, picked[0].day, "new", 1) for j in range(5)], SCHEMA)
        if i == 0:
            held.upsert("0", batch, coalesce=True)
            want = sinks.upsert(base, batch, ["k", "day"], coalesce=True)
        elif i == 1:
            held.insert_ignore("1", batch, "n")
            want = sinks.insert_ignore(base, batch, ["k", "day"], "n")
        else:
            held.replace("2", batch)
            want = sinks.replace_by_key(base, batch, ["k"])
        assert content(held.rows()) == content(want)
        stored = held.rows().collect()


def test_retention_reads_the_edge_only(spark, held):
    before = held.cells()
    want = [r for r in held.rows().collect() if r.day is None or str(r.day) >= "2020-06-10"]
    assert held.retain_since("r", 20, "2020-06-30")
    after = held.cells()
    assert sorted(map(str, want)) == sorted(map(str, held.rows().collect()))
    assert {c[1] for c in after if after[c] != before[c]} == {"2020-06"} and not any(c[1] < "2020-06" for c in after)


def test_keep_latest(spark, tmp_path):
    rows = spark.createDataFrame([(k, i, f"{k}{i}") for k in range(30) for i in range(1 + k % 4)], "k long, i int, v string")
    held = store.create(rows, str(tmp_path / "s"), ["k", "i"], bucket_by=["k"], buckets=40)
    before = held.cells()
    assert held.keep_latest("l", "i", 2)
    assert content(held.rows()) == content(sinks.keep_latest(rows, ["k"], "i", 2))
    few = {c for c in held._cells_of(rows.where("k % 4 < 2"))} - held._cells_of(rows.where("k % 4 > 1"))
    assert few and all(held.cells()[c] == before[c] for c in few)


def test_odd_stores(spark, tmp_path):
    empty = store.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), ["k"])
    assert empty.rows().count() == 0 and empty.upsert("nothing", empty.rows()) and empty.keep_latest("x", "n")
    assert empty.upsert("one", spark.createDataFrame([(None, None, "a", 1), (None, None, "b", 2)], SCHEMA)) and empty.rows().count() == 1
    for keys, how in ((["k"], {"date": "day"}), (["k"], {"bucket_by": ["v"]}), (["k"], {"grain": "week"})):
        with pytest.raises(ValueError):
            store.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "bad"), keys, **how)
    with pytest.raises(ValueError):
        store.create(spark.createDataFrame([], "k long, cell_bucket int"), str(tmp_path / "bad"), ["k"])
