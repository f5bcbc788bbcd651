"""Queries of keyword joins over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import keywords, text
from .inputs import table
from .registry import query

#: Rules from the data: twenty, whose words are those of five letters and more in some items of the benchmark.
_RULES = """w AS (SELECT DISTINCT CAST(item_id % 20 AS INTEGER) AS p, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM benchmark),
hit AS (SELECT doc_id, p, count(*) AS words, min(word) AS first FROM documents JOIN w ON contains(lower(text), word) GROUP BY ALL)"""


def rules(spark: SparkSession, sf: str) -> DataFrame:
    item = F.col("item_id") % 20
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0))
    rows = table(spark, sf, "benchmark").select(item.cast("int").alias("priority"), words.alias("word")).distinct()
    return rows.select(F.format_string("rule %02d", "priority").alias("rule"), "priority", F.lit(0).alias("place"), "word", F.lit(True).alias("any_case"))


@query(f"WITH {_RULES} SELECT doc_id, 'rule ' || lpad(CAST(p AS VARCHAR), 2, '0') AS rule, CAST(words AS INTEGER) AS words, first FROM hit")
def keyword_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's rules, with the number of their words that its whole text holds and the first of them."""
    found = keywords.find_rules(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), rules(spark, sf))
    return found.select("doc_id", F.inline("hits")).select("doc_id", "rule", "words", "first")


@query(f"""WITH {_RULES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, p) AS i, max(words) OVER (PARTITION BY doc_id) AS most, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS j, 'rule ' || lpad(CAST(p AS VARCHAR), 2, '0') AS rule FROM hit)
SELECT doc_id, coalesce(max(CASE WHEN j = 1 THEN rule END), '其他') AS industry, CASE WHEN count(rule) > 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS confidence, coalesce('关键词匹配: ' || max(CASE WHEN j = 1 THEN first END), '无匹配关键词') AS reasoning,
  coalesce(string_agg(CASE WHEN i <= 3 THEN rule || ' ' || words || ' ' || CAST(CAST(round(least(95.0, words / most * 50 + 50), 0) AS INTEGER) AS VARCHAR) END, ';' ORDER BY i), '') AS best, coalesce(string_agg(CASE WHEN j <= 3 THEN rule END, ';' ORDER BY j), '混合配置') AS tags FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id""")
def keyword_rules(spark: SparkSession, sf: str) -> DataFrame:
    """From one scan: the first rule of each document, its three best by words, and its tags."""
    found = keywords.find_rules(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), rules(spark, sf))
    best = F.transform(keywords.best_rules(F.col("hits")), lambda b: F.concat_ws(" ", b["rule"], b["score"].cast("string"), F.round(b["confidence"]).cast("int").cast("string")))
    return found.select("doc_id", keywords.classified(F.col("hits")).alias("c"), F.array_join(best, ";").alias("best"), F.array_join(keywords.tags(F.col("hits")), ";").alias("tags")).select("doc_id", "c.*", "best", "tags")


def _values(categories) -> str:
    return ", ".join(f"({i}, {j}, '{name}', '{word}')" for i, (name, words) in enumerate(categories) for j, word in enumerate(words))


@query(f"""WITH w(p, j, rule, word) AS (VALUES {_values(text.FUND_INDUSTRIES)}), h AS (SELECT doc_id, p, rule, arg_min(word, j) AS first FROM documents JOIN w ON contains(lower(text), lower(word)) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM h)
SELECT doc_id, coalesce(rule, '其他') AS industry, CASE WHEN rule IS NULL THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS confidence, coalesce('关键词匹配: ' || first, '无匹配关键词') AS reasoning FROM documents LEFT JOIN (SELECT * FROM k WHERE i = 1) USING (doc_id)""")
def classify_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The fund industries' words, as a table, over whole texts."""
    found = keywords.find_rules(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), keywords.rules_of(spark, text.FUND_INDUSTRIES))
    return found.select("doc_id", keywords.classified(F.col("hits")).alias("c")).select("doc_id", "c.*")
