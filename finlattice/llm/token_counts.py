"""Token counts as delta-maintained rollups.

A store holds, by batch, a ledger of document counts and signed deltas of the additive totals by
source, language and tokenizer version.  A batch of changes (insert, delete, or a revised count) is
joined with the live ledger on (document, tokenizer): what a document counted so far is taken off,
what it counts now is added, and only the sums of both are written.  Totals are sums of deltas;
documents are never counted again.

Commits are idempotent: a batch writes its ledger and deltas under its own name, replacing what a
lost attempt left, and then its commit mark; readers see only marked batches, and a batch that is
marked already changes nothing.  A batch may have any name: its folders are called by a digest of it.
The ledger is kept in `buckets` parts by a hash of the document's id (create() sets their number), and
a commit reads the parts that its batch touches.  compact() folds all batches of a store into one of a
new store, which keeps their names, so that a late repeat of any of them still changes nothing.
A store takes one writer at a time; two at once would take off the same counts twice.

Defined results: the last of a batch's changes to a document counts (by `seq`, then by value);
an insert of a known document is a revision; deletes of unknown documents do nothing; null sources
and languages are groups of their own; rows with a null id cannot be tracked and are left out; null
texts have 0 tokens; empty batches commit; groups without documents left are not reported.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import plain, slices
from .token_files import tokenizer

LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, live boolean, position long, batch string, bucket int"
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long, batch string"
COMMITS = "batch string, position long"
BUCKETS = 64
#: The batch that all others are folded into.
FOLDED = "\0folded"
KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]


def create(spark: SparkSession, store: str, buckets: int = BUCKETS) -> None:
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{store}/settings")
    for name, schema in (("deltas", DELTAS), ("commits", COMMITS)):
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{store}/{name}/from=start")


def _from(batch: str) -> str:
    """The folder of a batch."""
    return f"from={hashlib.sha256(batch.encode()).hexdigest()}"


def _buckets(spark: SparkSession, store: str) -> int:
    return spark.read.schema("buckets int").parquet(f"{store}/settings").first()[0]


def _bucket(id_: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(buckets)).cast("int")


def _table(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    """The rows of all committed batches."""
    commits = spark.read.schema(COMMITS).parquet(f"{store}/commits/from=*")
    if name == "commits":
        return commits
    if commits.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{store}/{name}").parquet(f"{store}/{name}/from=*")
    return rows.join(commits.select("batch").distinct(), "batch", "left_semi").drop("from")  # a row a batch


def live(spark: SparkSession, store: str, touched: DataFrame | None = None) -> DataFrame:
    """The documents that count now, of those touched (KEY and bucket): (doc_id, tokenizer, source, lang, n_tokens)."""
    rows = _table(spark, store, "ledger", LEDGER)
    if touched is not None:
        parts = [r[0] for r in touched.select("bucket").distinct().collect()]  # at most as many as the store has
        rows = rows.where(F.col("bucket").isin(parts)).join(touched.select(*KEY), KEY, "left_semi")
    last = rows.groupBy(KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens", "live"), "position").alias("s"))
    return last.where("s.live").select(*KEY, "s.source", "s.lang", "s.n_tokens")


def commit(spark: SparkSession, store: str, batch: str, changes: DataFrame) -> bool:
    """Applies changes (op, seq, doc_id, tokenizer, source, lang, n_tokens); False if the batch was there already."""
    there, last_position = _table(spark, store, "commits", COMMITS).agg(F.max(F.col("batch") == batch), F.max("position")).first()
    if there:
        return False
    position = (last_position or 0) + 1
    last = changes.where("doc_id IS NOT NULL").groupBy(KEY).agg(F.max(F.struct("seq", F.struct("op", "source", "lang", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")).alias("s"))).alias("m"))
    last = last.select(*KEY, "m.s.op", "m.s.source", "m.s.lang", "m.s.n_tokens", (F.col("m.s.op") != "delete").alias("live"))
    ledger = last.select(*KEY, "source", "lang", "n_tokens", "live", F.lit(position).cast("long").alias("position"), F.lit(batch).alias("batch"), _bucket("doc_id", _buckets(spark, store)).alias("bucket"))
    now = _write_ledger(spark, store, batch, ledger)
    taken = live(spark, store, now.select(*KEY, "bucket")).select(*GROUP, F.lit(-1).alias("sign"), "n_tokens")
    added = now.where("live").select(*GROUP, F.lit(1).alias("sign"), "n_tokens")
    deltas = taken.union(added).groupBy(GROUP).agg(F.sum(F.col("sign").cast("long")).alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))
    deltas.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{store}/deltas/{_from(batch)}")
    spark.createDataFrame([(batch, position)], COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/{_from(batch)}")
    return True


def _write_ledger(spark: SparkSession, store: str, batch: str, ledger: DataFrame) -> DataFrame:
    """Writes a batch's ledger by bucket, and reads it back."""
    path = f"{store}/ledger/{_from(batch)}"
    ledger.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def compact(spark: SparkSession, store: str, into: str, buckets: int | None = None) -> None:
    """Writes the state of a store to a new one: live documents, totals, and the names of all batches."""
    buckets = buckets or _buckets(spark, store)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{into}/settings")
    held = live(spark, store).select(*KEY, "source", "lang", "n_tokens", F.lit(True).alias("live"), F.lit(0).cast("long").alias("position"), F.lit(FOLDED).alias("batch"), _bucket("doc_id", buckets).alias("bucket"))
    _write_ledger(spark, into, FOLDED, held)
    totals(spark, store).withColumn("batch", F.lit(FOLDED)).write.parquet(f"{into}/deltas/{_from(FOLDED)}")
    folded = spark.createDataFrame([(FOLDED, 0)], COMMITS)
    _table(spark, store, "commits", COMMITS).where(F.col("batch") != FOLDED).unionByName(folded).write.parquet(f"{into}/commits/{_from(FOLDED)}")


def totals(spark: SparkSession, store: str) -> DataFrame:
    """(source, lang, tokenizer, docs, tokens) over all committed batches."""
    sums = _table(spark, store, "deltas", DELTAS).groupBy(GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    return sums.where("docs <> 0 OR tokens <> 0")


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text, counted with the tokenizer file at path."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        column, sizes = plain(texts), []
        for a, b in slices(column):
            sizes.append(pa.array(tokenizer(path).encode(column[a:b])[1], pa.int64()))
        return pa.concat_arrays(sizes) if sizes else pa.array([], pa.int64())

    return docs.withColumn(into, count(F.col(text)))


def changes(docs: DataFrame, op: str, version: str, n_tokens: str = "n_tokens", id_: str = "doc_id") -> DataFrame:
    """docs (with source, lang and a count) as a batch of one kind of change."""
    return docs.select(F.lit(op).alias("op"), F.lit(0).alias("seq"), F.col(id_).cast("long").alias("doc_id"), F.lit(version).alias("tokenizer"), "source", "lang", F.col(n_tokens).cast("long").alias("n_tokens"))
