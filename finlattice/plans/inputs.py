"""Domain tables made from the test tables, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-08-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: an order priority is a symbol, an order a price of its day."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("bar_date"), "o_orderkey", F.col("o_totalprice").alias("p"))
    return o.groupBy("symbol", "bar_date").agg(F.min_by("p", "o_orderkey").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"), F.round(F.sum("p"), 2).alias("amount"))


BARS = """bars AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS bar_date, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume, round(sum(o_totalprice), 2) AS amount
  FROM orders GROUP BY ALL
)"""
RETURNS = f"{BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))"


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for some symbols."""
    rows = [("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium")]
    return spark.createDataFrame(rows, "symbol string, name string")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: the source's number is the industry, the id sets day and confidence."""
    d = table(spark, sf_dir, "documents")
    code = F.concat(F.lit("I"), F.lpad(F.regexp_extract("source", r"(\d+)", 1), 3, "0"))
    return d.select(F.col("doc_id").alias("news_id"), code.alias("industry_code"), (F.col("doc_id") % 101 / 100.0).alias("confidence"), F.date_sub(F.lit(AS_OF).cast("date"), (F.col("doc_id") % 20).cast("int")).alias("classified_at"), F.substring("text", 1, 20).alias("title"))


NEWS = f"""news AS (
  SELECT doc_id AS news_id, 'I' || lpad(regexp_extract(source, '(\\d+)', 1), 3, '0') AS industry_code, (doc_id % 101) / 100.0::DOUBLE AS confidence,
    DATE '{AS_OF}' - CAST(doc_id % 20 AS INTEGER) AS classified_at, substr(text, 1, 20) AS title FROM documents
)"""


def fund_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as funds, each with three industries."""
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("fund_code"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    n = (F.col("fund_code") * 7 + F.col("i") * 5) % 23
    return rows.select("fund_code", F.concat(F.lit("industry "), n.cast("string")).alias("industry"), ((F.col("fund_code") * 13 + F.col("i") * 29) % 101).cast("double").alias("confidence"))


FUND_INDUSTRIES = """fi AS (
  SELECT s_suppkey AS fund_code, 'industry ' || CAST((s_suppkey * 7 + i * 5) % 23 AS VARCHAR) AS industry, CAST((s_suppkey * 13 + i * 29) % 101 AS DOUBLE) AS confidence
  FROM supplier, (SELECT unnest(range(0, 3)) AS i)
)"""


def codes(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(F.concat(F.lit("industry "), F.col("id").cast("string")).alias("industry"), F.concat(F.lit("I"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("industry_code"))


CODES = "codes AS (SELECT 'industry ' || CAST(i AS VARCHAR) AS industry, 'I' || lpad(CAST(i AS VARCHAR), 3, '0') AS industry_code FROM range(0, 20) t(i))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits don't differ; -0 becomes 0."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(sql: str, doubles: str, rest: str, digits: int = 6) -> str:
    """The same for a query: names of its double columns and of the others, by commas."""
    names = [c.strip() for c in doubles.split(",") if c.strip()]
    other = [c.strip() for c in rest.split(",") if c.strip()]
    return f"SELECT {', '.join(other + [f'round({c}, {digits}) + 0.0 AS {c}' for c in names])} FROM ({sql})"


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + 0.0
