"""A keyed table that changes in place: a batch rewrites the cells that it touches and no others.

Rows lie in cells: a hash bucket of `bucket_by` (part of the key) and, with `date`, a month or a year.  A change
reads the cells of its batch, makes their new rows with the operators of `sinks`, and writes those to
a new folder; then a manifest (cell, folder) of all cells; then one row in `commits`, which makes the
version visible.  Readers take the last committed manifest, so they see whole versions, and what a
killed writer has left is not in any.  A batch has a name; one that is committed already changes
nothing.  Retention drops whole periods from the manifest and rewrites only that of its limit.

Skewed cells are split over several files as they are written (rebalanced partitions), cells of a
few rows share a task.  The driver holds the manifest, a row a cell: buckets times periods, whatever
the number of rows.  A table takes one writer at a time; of two that begin from the same version the
second fails, where the store refuses to write a folder that is there.

Defined results: null keys equal each other and lie in one bucket; null dates are a period of their own,
which retention leaves; empty batches commit; a store without rows reads as an empty table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sinks

BUCKETS = 16
#: Lengths of the dates' beginnings that are periods.
GRAINS = {"month": 7, "year": 4}
CELL = ["cell_bucket", "cell_period"]
NO_PERIOD = "none"
MANIFEST = "cell_bucket int, cell_period string, folder string"
COMMITS = "version long, batch string, folder string"
Cells = dict[tuple[int, str], str]


class KeyedStore:
    """Opened by create() or open_store()."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], bucket_by: list[str], date: str | None, buckets: int, grain: str):
        self.spark, self.path, self.schema, self.keys, self.bucket_by, self.date, self.buckets, self.grain = spark, path, schema, keys, bucket_by, date, buckets, grain

    # what is there

    def commits(self) -> list[tuple[int, str, str]]:
        """(version, batch, manifest folder) of all versions, the newest last."""
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits/*").collect()  # a row a commit
        return sorted((r.version, r.batch, r.folder) for r in rows)

    def cells(self, version: int | None = None) -> Cells:
        """The folder of each cell, now or as of a version."""
        folder = [f for v, _, f in self.commits() if version is None or v <= version][-1]
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{folder}").collect()
        return {(r.cell_bucket, r.cell_period): r.folder for r in rows}

    def rows(self, version: int | None = None) -> DataFrame:
        """The whole table."""
        return self._read(self.cells(version))

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """Rows whose `bucket_by` values keys holds; other buckets are not read."""
        touched = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # at most as many as buckets
        held = self._read({c: f for c, f in self.cells().items() if c[0] in touched})
        same = keys.select(*self.bucket_by).distinct()
        return held.alias("h").join(same.alias("k"), sinks._same("h", "k", self.bucket_by), "left_semi")

    def rows_between(self, first: str, last: str) -> DataFrame:
        """Rows with dates from first to last; other periods are not read."""
        n = GRAINS[self.grain]
        own = {c: f for c, f in self.cells().items() if c[1] != NO_PERIOD and first[:n] <= c[1] <= last[:n]}
        return self._read(own).where(F.to_date(self.date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))

    def _read(self, cells: Cells) -> DataFrame:
        if not cells:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{folder}/cell_bucket={b}/cell_period={m}" for (b, m), folder in sorted(cells.items())])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _period(self) -> Column:
        return F.coalesce(F.substring(F.to_date(self.date).cast("string"), 1, GRAINS[self.grain]), F.lit(NO_PERIOD)) if self.date else F.lit(NO_PERIOD)

    def _in_cells(self, df: DataFrame) -> DataFrame:
        return df.withColumns({CELL[0]: self._bucket(), CELL[1]: self._period()})

    # changes

    def _change(self, batch: str, touched: Callable[[Cells], set], change: Callable[[DataFrame], DataFrame]) -> bool:
        """Rewrites the touched cells with what change makes of their rows; False if the batch is there already."""
        commits = self.commits()
        if any(b == batch for _, b, _ in commits):
            return False
        cells = self.cells()
        own = touched(cells)
        folder, kept = uuid.uuid4().hex, {c: f for c, f in cells.items() if c not in own}
        if own:
            new = change(self._read({c: f for c, f in cells.items() if c in own})).select(*self.schema.names)
            kept |= self._write(folder, new)
        self._publish(commits[-1][0] + 1, batch, folder, kept)
        return True

    def _write(self, folder: str, rows: DataFrame) -> Cells:
        """Rows as files of their cells, skewed ones split, and the cells that came out."""
        path = f"{self.path}/data/{folder}"
        self._in_cells(rows).hint("rebalance", *CELL).write.partitionBy(*CELL).parquet(path)
        there = self.spark.read.schema(T.StructType([*self.schema.fields, *T.StructType.fromDDL("cell_bucket int, cell_period string").fields])).parquet(path)
        return {(r[0], r[1]): folder for r in there.select(*CELL).distinct().collect()}

    def _publish(self, version: int, batch: str, folder: str, cells: Cells) -> None:
        rows = [(b, m, f) for (b, m), f in sorted(cells.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/{folder}")
        self.spark.createDataFrame([(version, batch, folder)], COMMITS).coalesce(1).write.parquet(f"{self.path}/commits/{version:012}")

    def _cells_of(self, df: DataFrame) -> set:
        """Cells that rows of df belong to."""
        return {(r[0], r[1]) for r in self._in_cells(df).select(*CELL).distinct().collect()}

    def _buckets_of(self, df: DataFrame) -> Callable[[Cells], set]:
        """All periods of the buckets that df touches, and the buckets that have no cell yet."""
        own = {r[0] for r in df.select(self._bucket()).distinct().collect()}
        return lambda cells: {c for c in cells if c[0] in own} | {(b, NO_PERIOD) for b in own}

    def upsert(self, batch: str, rows: DataFrame, columns: list[str] | None = None, coalesce: bool = False, seq: str | Column | None = None) -> bool:
        """As sinks.upsert()."""
        return self._change(batch, lambda _: self._cells_of(rows), lambda held: sinks.upsert(held, rows, self.keys, columns, coalesce, seq))

    def insert_ignore(self, batch: str, rows: DataFrame, seq: str) -> bool:
        """As sinks.insert_ignore()."""
        return self._change(batch, lambda _: self._cells_of(rows), lambda held: sinks.insert_ignore(held, rows, self.keys, seq))

    def replace(self, batch: str, rows: DataFrame) -> bool:
        """All rows with the batch's `bucket_by` values give way to the batch's, in every period."""
        return self._change(batch, self._buckets_of(rows), lambda held: sinks.replace_by_key(held, rows, self.bucket_by))

    def delete(self, batch: str, keys: DataFrame) -> bool:
        """Rows whose key the batch has go."""
        return self._change(batch, lambda cells: self._cells_of(keys) & cells.keys(), lambda held: sinks.without(held, keys, self.keys))

    def retain_since(self, batch: str, days: int, as_of: str) -> bool:
        """Rows older than `days` before as_of go: whole periods without being read; null dates stay."""
        n, limit = GRAINS[self.grain], self.spark.range(1).select(F.date_sub(F.lit(as_of).cast("date"), days).cast("string")).first()[0]

        def old(cells: Cells) -> set:
            return {c for c in cells if c[1] != NO_PERIOD and c[1] <= limit[:n]}

        def change(held: DataFrame) -> DataFrame:
            """Of periods before the limit's no file is read."""
            edge = {c: f for c, f in self.cells().items() if c[1] == limit[:n]}
            return self._read(edge).where(F.to_date(self.date) >= F.lit(limit).cast("date"))

        return self._change(batch, old, change)

    def keep_latest(self, batch: str, order: str, n: int = 1) -> bool:
        """Of the rows that agree in `bucket_by` the newest n stay; buckets without more are left alone."""
        many = self.rows().groupBy(*self.bucket_by).count().where(F.col("count") > n)
        return self._change(batch, lambda cells: self._buckets_of(many)(cells) & cells.keys(), lambda held: sinks.keep_latest(held, self.bucket_by, order, n))

    def vacuum(self, versions: int = 2) -> int:
        """Removes folders that none of the last versions refers to; the number removed.  Not while others read older versions or write.

        Files are deleted through the driver's Hadoop file system, as Spark has no operator for it.
        """
        commits = self.commits()
        used = {f for _, _, f in commits[-versions:]}  # manifests
        data = {f for v, _, _ in commits[-versions:] for f in self.cells(v).values()}
        hadoop, gone = self.spark.sparkContext._jvm.org.apache.hadoop.fs, 0
        fs = hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for kind, keep in (("data", data), ("manifests", used)):
            place = hadoop.Path(f"{self.path}/{kind}")
            for status in fs.listStatus(place) if fs.exists(place) else []:
                if status.getPath().getName() not in keep:
                    fs.delete(status.getPath(), True)
                    gone += 1
        return gone


def create(rows: DataFrame, path: str, keys: list[str], bucket_by: list[str] | None = None, date: str | None = None, buckets: int = BUCKETS, grain: str = "month") -> KeyedStore:
    """A new store at path, with rows, whose keys must be unique.

    bucket_by: the part of the key that buckets are made of (all of it); date: a column of the key whose periods (grain: month or year) are cells.
    Choose both so that a cell is a file or some.
    """
    bucket_by = bucket_by or keys
    if not set(bucket_by) <= set(keys) or date and date not in keys:
        raise ValueError("bucket_by and date must be part of the key")
    if grain not in GRAINS:
        raise ValueError(f"no grain {grain!r}")
    if set(CELL) & set(rows.columns):
        raise ValueError(f"columns {CELL} are the store's own")
    spark, schema = rows.sparkSession, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    settings = json.dumps({"schema": schema.json(), "keys": keys, "bucket_by": bucket_by, "date": date, "buckets": buckets, "grain": grain})
    spark.createDataFrame([(settings,)], "value string").coalesce(1).write.text(f"{path}/settings")
    store, folder = KeyedStore(spark, path, schema, keys, bucket_by, date, buckets, grain), uuid.uuid4().hex
    store._publish(0, "", folder, store._write(folder, rows))
    return store


def open_store(spark: SparkSession, path: str) -> KeyedStore:
    s = json.loads(spark.read.text(f"{path}/settings").first()[0])
    return KeyedStore(spark, path, T.StructType.fromJson(json.loads(s["schema"])), s["keys"], s["bucket_by"], s["date"], s["buckets"], s["grain"])
