"""Keyed writes as table-to-table operators: each returns the table after the change.

Spark tables have no unique index, so each operator keeps its keys unique itself: the batch is
reduced to one row a key first, then met with the stored rows in one shuffle on the key
(replace_by_key() puts in all rows of a key).
Null keys equal each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(batch: DataFrame, keys: list[str], seq: str | Column) -> DataFrame:
    """One row of each key, that with the greatest seq."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq) if isinstance(seq, str) else seq.desc())
    return batch.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def _same(a: str, b: str, keys: list[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return same


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], columns: list[str] | None = None, coalesce: bool = False, seq: str | Column | None = None) -> DataFrame:
    """Stored rows with those of the batch put in by key.

    columns: those that an existing row takes over (all by default); coalesce: a null in the batch
    leaves the stored value; seq: of a key's batch rows that with the greatest counts (by default
    the greatest of all its values in column order).
    """
    rest = [c for c in stored.columns if c not in keys]
    batch = last_wins(batch, keys, F.struct(*rest) if seq is None else seq)
    taken = set(rest if columns is None else columns)
    joined = stored.withColumn("_old", F.lit(True)).alias("o").join(batch.withColumn("_new", F.lit(True)).alias("n"), _same("o", "n", keys), "full")

    def value(c: str) -> Column:
        old, new = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c not in taken:
            return F.when(F.col("o._old"), old).otherwise(new)
        return F.coalesce(new, old) if coalesce else F.when(F.col("n._new"), new).otherwise(old)

    return joined.select(*[(F.coalesce(f"o.{c}", f"n.{c}") if c in keys else value(c)).alias(c) for c in stored.columns])


def without_zeros(batch: DataFrame, columns: list[str]) -> DataFrame:
    """Values as a fund's or index's rows are put in: 0 stands for one that is missing."""
    return batch.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in columns})


def insert_ignore(stored: DataFrame, batch: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Stored rows and those of the batch with new keys; of a key's batch rows the first counts."""
    w = Window.partitionBy(*keys).orderBy(seq)
    first = batch.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(*stored.columns)
    return stored.unionByName(without(first, stored, keys))


def without(df: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key others don't have (anti join)."""
    return df.alias("a").join(others.select(*keys).alias("b"), _same("a", "b", keys), "left_anti")


def replace_by_key(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """All stored rows of the batch's keys give way to the batch's rows."""
    return without(stored, batch, keys).unionByName(batch.select(*stored.columns))


def retain_since(df: DataFrame, days: int, as_of: str, date: str) -> DataFrame:
    return df.where(F.col(date) >= F.date_sub(F.lit(as_of).cast("date"), days))


def keep_latest(df: DataFrame, keys: list[str], order: str, n: int = 1) -> DataFrame:
    """The newest n rows of each key stay."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def set_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    """Column updates of the rows that fit."""
    return df.withColumns({c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def meta_after(meta: DataFrame, batch: DataFrame, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """first_bar falls to the batch's first date; last_bar becomes the batch's last, older or not."""
    span = batch.groupBy(key).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    out = meta.join(span, key, "full")
    return out.withColumns({"first_bar": F.least("first_bar", "_first"), "last_bar": F.coalesce("_last", "last_bar")}).drop("_first", "_last")


def backfill_first_date(meta: DataFrame, bars: DataFrame, key: str = "symbol", date: str = "bar_date") -> DataFrame:
    """Fills missing first_bar values from the bars."""
    first = bars.groupBy(key).agg(F.min(date).alias("_first"))
    return meta.join(first, key, "left").withColumn("first_bar", F.coalesce("first_bar", "_first")).drop("_first")


def after_high_water(source: DataFrame, stored: DataFrame, as_of: str, key: str = "symbol", date: str = "bar_date", default_days: int = 31) -> DataFrame:
    """Source rows newer than the key's last stored date; keys not stored begin default_days before as_of."""
    mark = stored.groupBy(key).agg(F.max(date).alias("_mark"))
    today = F.lit(as_of).cast("date")
    start = F.coalesce(F.date_add("_mark", 1), F.date_sub(today, default_days))
    return source.join(mark, key, "left").where((F.col(date) >= start) & (F.col(date) <= today)).drop("_mark")


def validated_predictions(df: DataFrame) -> DataFrame:
    """years outside 1 to 3 become 1; magnitude_5 stays only with five values; prob_down is added."""
    return df.withColumns({"years": F.when(F.col("years").isin(1, 2, 3), F.col("years")).otherwise(1), "magnitude_5": F.when(F.size("magnitude_5") == 5, F.col("magnitude_5")), "prob_down": F.round(1 - F.col("prob_up"), 4)})


def chart_columns(df: DataFrame, key: str, date: str, columns: list[str]) -> DataFrame:
    """A row for each key: dates and values as aligned arrays in date order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), *columns)))
    out = df.groupBy(key).agg(rows.alias("_rows"))
    return out.select(key, F.transform("_rows", lambda r: r["d"]).alias("dates"), *[F.transform("_rows", _field(c)).alias(c) for c in columns])


def _field(name: str):
    return lambda r: r[name]


def write_text_report(df: DataFrame, path: str, template: str) -> None:
    """A line of text for each row: template is a printf format over the columns in order."""
    df.select(F.format_string(template, *df.columns).alias("value")).write.mode("overwrite").text(path)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
