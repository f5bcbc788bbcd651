"""Queries of the relational operators: scans, keyed writes, joins, aggregations, top rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import market, scan, text
from ..sources import readers, sinks
from .inputs import AS_OF, BARS, CODES, FUND_INDUSTRIES, NEWS, bars, codes, fund_industries, meta, news, r, rounded, table
from .registry import query

S, D = SparkSession, DataFrame


@query(f"WITH {BARS} SELECT * FROM bars WHERE symbol = '1-URGENT' AND bar_date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31'")
def scan_range(spark: S, sf: str) -> D:
    return scan.range_scan(bars(spark, sf), ["1-URGENT"], "1994-01-01", "1995-12-31")


@query(f"WITH {BARS} SELECT * FROM bars WHERE symbol IN ('1-URGENT', '2-HIGH') AND bar_date >= DATE '1996-01-01' ORDER BY bar_date DESC, symbol LIMIT 50 OFFSET 50")
def scan_page(spark: S, sf: str) -> D:
    rows = scan.range_scan(bars(spark, sf), ["1-URGENT", "2-HIGH"], "1996-01-01")
    return scan.page(rows, [F.desc("bar_date"), F.col("symbol")], 2, 50)


@query(f"WITH {BARS} SELECT symbol, bar_date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_date DESC) AS k FROM bars) WHERE k <= 60")
def scan_last_n(spark: S, sf: str) -> D:
    return scan.last_n(bars(spark, sf), 60).select("symbol", "bar_date", "close")


@query(f"WITH {BARS} SELECT symbol, bar_date, close FROM bars WHERE bar_date >= DATE '{AS_OF}' - 90")
def scan_since_days(spark: S, sf: str) -> D:
    return scan.since_days(bars(spark, sf), 90, AS_OF).select("symbol", "bar_date", "close")


@query(f"WITH {BARS} SELECT symbol, bar_date, close FROM bars WHERE symbol = '5-LOW'")
def scan_since_days_one_key(spark: S, sf: str) -> D:
    """A key given: the days are ignored."""
    return scan.since_days(bars(spark, sf), 90, AS_OF, only={"symbol": "5-LOW"}).select("symbol", "bar_date", "close")


@query(f"WITH {BARS} SELECT symbol, bar_date, close FROM bars WHERE symbol = '5-LOW' AND bar_date >= DATE '{AS_OF}' - 90")
def scan_since_days_strict(spark: S, sf: str) -> D:
    return scan.since_days(bars(spark, sf), 90, AS_OF, only={"symbol": "5-LOW"}, strict=True).select("symbol", "bar_date", "close")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(c_name, '12') OR contains(c_mktsegment, '12') ORDER BY c_name LIMIT 50")
def search_like(spark: S, sf: str) -> D:
    return scan.search(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "12", ["c_name", "c_mktsegment"], 500)


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def where_dynamic(spark: S, sf: str) -> D:
    return scan.where_all(table(spark, sf, "customer"), c_mktsegment="BUILDING", c_nationkey=7, c_name="all", c_acctbal=None).select("c_custkey", "c_nationkey", "c_acctbal")


@query("SELECT p_partkey, p_size % 3 = 1 AS tagged FROM part")
def json_contains(spark: S, sf: str) -> D:
    tags = F.to_json(F.array(F.concat(F.lit("t"), (F.col("p_size") % 3).cast("string")), F.lit("all")))
    return table(spark, sf, "part").withColumn("tags", tags).select("p_partkey", scalar.has_tag(F.col("tags"), "t1").alias("tagged"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_field(spark: S, sf: str) -> D:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("""SELECT c_custkey, CASE WHEN c_custkey < 100000 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS code, c_custkey <= 999999 AS is_a, FALSE AS is_hk, 'a' AS market FROM customer""")
def code_predicates(spark: S, sf: str) -> D:
    text_ = F.col("c_custkey").cast("string")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.length(text_) < 6, F.lpad(text_, 6, "0")).otherwise(text_).alias("code"))
    c = F.col("code")
    return rows.withColumns({"is_a": scalar.is_a_share(c), "is_hk": scalar.is_hk_share(c), "market": scalar.market_of(c)})


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, day = CAST(last_day(day) - greatest(isodow(last_day(day)) - 5, 0)::INTEGER AS DATE) AS month_end,
  day = CAST(last_day(day) - greatest(isodow(last_day(day)) - 5, 0)::INTEGER AS DATE) AND month(day) % 3 = 0 AS quarter_end FROM d""")
def business_month_end(spark: S, sf: str) -> D:
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", scalar.last_business_day(F.col("day")).alias("month_end"), scalar.last_business_day(F.col("day"), True).alias("quarter_end"))


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_per_key(spark: S, sf: str) -> D:
    return scan.latest_per_key(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def latest_rows(spark: S, sf: str) -> D:
    return scan.latest(table(spark, sf, "events").select("event_id", "ts", "user_id"), ["ts", "event_id"], 20)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def exists_rows(spark: S, sf: str) -> D:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return scan.with_any(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query("SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_rows(spark: S, sf: str) -> D:
    return scan.distinct_values(table(spark, sf, "customer"), "c_mktsegment")


@query(f"WITH {BARS} SELECT symbol, min(bar_date) AS first_date, max(bar_date) AS last_date, count(*) AS n_rows FROM bars GROUP BY symbol")
def first_and_last(spark: S, sf: str) -> D:
    return scan.first_and_last(bars(spark, sf))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def counts_by(spark: S, sf: str) -> D:
    return scan.counts_by(table(spark, sf, "events"), "event_type")


# Keyed writes: the orders before 1999 are stored, the batch has those since 1998.


def _stored(spark: S, sf: str) -> D:
    return table(spark, sf, "orders").where("o_orderdate < '1999-01-01'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


def _batch(spark: S, sf: str) -> D:
    return table(spark, sf, "orders").where("o_orderdate >= '1998-01-01'").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 != 0, "N").alias("status"), (F.col("o_totalprice") + 1).alias("price"))


_PAIR = """s AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderdate < '1999-01-01'),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN 'N' END AS status, o_totalprice + 1 AS price FROM orders WHERE o_orderdate >= '1998-01-01')"""


@query(f"WITH {_PAIR} SELECT k, CASE WHEN b.k IS NULL THEN s.status ELSE b.status END AS status, CASE WHEN b.k IS NULL THEN s.price ELSE b.price END AS price FROM s FULL JOIN b USING (k)")
def upsert_rows(spark: S, sf: str) -> D:
    return sinks.upsert(_stored(spark, sf), _batch(spark, sf), ["k"])


@query(f"WITH {_PAIR} SELECT k, coalesce(b.status, s.status) AS status, coalesce(b.price, s.price) AS price FROM s FULL JOIN b USING (k)")
def upsert_coalescing(spark: S, sf: str) -> D:
    return sinks.upsert(_stored(spark, sf), _batch(spark, sf), ["k"], coalesce=True)


@query(f"WITH {_PAIR} SELECT k, CASE WHEN s.k IS NULL THEN b.status ELSE s.status END AS status, CASE WHEN b.k IS NULL THEN s.price ELSE b.price END AS price FROM s FULL JOIN b USING (k)")
def upsert_some_columns(spark: S, sf: str) -> D:
    return sinks.upsert(_stored(spark, sf), _batch(spark, sf), ["k"], columns=["price"])


@query(f"WITH {_PAIR}, z AS (SELECT k, status, nullif(CASE WHEN k % 3 = 0 THEN 0 ELSE price END, 0) AS price FROM b) SELECT k, CASE WHEN z.k IS NULL THEN s.status ELSE z.status END AS status, CASE WHEN z.k IS NULL THEN s.price ELSE z.price END AS price FROM s FULL JOIN z USING (k)")
def upsert_values(spark: S, sf: str) -> D:
    """Every third value of the batch is 0, which is put in as missing."""
    batch = _batch(spark, sf).withColumn("price", F.when(F.col("k") % 3 == 0, 0.0).otherwise(F.col("price")))
    return sinks.upsert(_stored(spark, sf), sinks.without_zeros(batch, ["price"]), ["k"])


@query(f"WITH {_PAIR} SELECT * FROM s UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM s)")
def insert_ignore(spark: S, sf: str) -> D:
    batch = _batch(spark, sf).withColumn("seq", F.col("k"))
    return sinks.insert_ignore(_stored(spark, sf), batch, ["k"], "seq")


@query("SELECT * FROM orders WHERE o_orderdate >= '1999-01-01' UNION ALL SELECT * FROM orders WHERE o_orderdate < '1999-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '1999-01-01')")
def replace_by_key(spark: S, sf: str) -> D:
    """Customers with orders since 1999 keep only those."""
    orders = table(spark, sf, "orders")
    return sinks.replace_by_key(orders.where("o_orderdate < '1999-01-01'"), orders.where("o_orderdate >= '1999-01-01'"), ["o_custkey"])


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 1")
def keep_latest(spark: S, sf: str) -> D:
    return sinks.keep_latest(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 10")
def retain_since(spark: S, sf: str) -> D:
    events = table(spark, sf, "events").select("event_id", "ts")
    last = events.agg(F.max(F.to_date("ts"))).first()[0]
    return sinks.retain_since(events.withColumn("day", F.to_date("ts")), 10, str(last), "day").drop("day")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN value * 2 ELSE value END AS value FROM events")
def column_update(spark: S, sf: str) -> D:
    return sinks.set_where(table(spark, sf, "events").select("event_id", "event_type", "value"), F.col("event_type") == "click", value=F.col("value") * 2).drop("event_type")


@query(f"""WITH {BARS}, m AS (SELECT symbol, min(bar_date) AS f, max(bar_date) AS l FROM bars WHERE bar_date < DATE '1996-01-01' GROUP BY symbol),
b AS (SELECT symbol, min(bar_date) AS f, max(bar_date) AS l FROM bars WHERE bar_date BETWEEN DATE '1995-06-01' AND DATE '1997-01-01' GROUP BY symbol)
SELECT symbol, least(m.f, b.f) AS first_bar, coalesce(b.l, m.l) AS last_bar FROM m FULL JOIN b USING (symbol)""")
def meta_maintenance(spark: S, sf: str) -> D:
    rows = bars(spark, sf)
    old = rows.where("bar_date < '1996-01-01'").groupBy("symbol").agg(F.min("bar_date").alias("first_bar"), F.max("bar_date").alias("last_bar"))
    return sinks.meta_after(old, rows.where("bar_date BETWEEN '1995-06-01' AND '1997-01-01'"))


@query(f"WITH {BARS} SELECT symbol, min(bar_date) AS first_bar FROM bars GROUP BY symbol")
def backfill(spark: S, sf: str) -> D:
    rows = bars(spark, sf)
    return sinks.backfill_first_date(rows.select("symbol").distinct().withColumn("first_bar", F.lit(None).cast("date")), rows)


@query(f"""WITH {BARS}, m AS (SELECT symbol, max(bar_date) AS mark FROM bars WHERE bar_date < DATE '1998-06-01' AND symbol <> '5-LOW' GROUP BY symbol)
SELECT symbol, bar_date, close FROM bars LEFT JOIN m USING (symbol) WHERE bar_date >= coalesce(mark + 1, DATE '{AS_OF}' - 31) AND bar_date <= DATE '{AS_OF}'""")
def after_high_water(spark: S, sf: str) -> D:
    rows = bars(spark, sf)
    return sinks.after_high_water(rows, rows.where("bar_date < '1998-06-01' AND symbol <> '5-LOW'"), AS_OF).select("symbol", "bar_date", "close")


# Joins and aggregations.


@query(f"WITH {BARS} SELECT symbol, CASE symbol WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE symbol END AS name FROM (SELECT DISTINCT symbol FROM bars)")
def names_of_keys(spark: S, sf: str) -> D:
    return market.with_meta(bars(spark, sf), meta(spark, sf))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(spark: S, sf: str) -> D:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return sinks.without(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), orders, ["c_custkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) USING (o_custkey, o_orderkey)")
def greatest_per_group(spark: S, sf: str) -> D:
    return scan.latest_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


_PREDICTIONS = f"""{BARS}, p AS (SELECT symbol, bar_date AS predict_date, CASE WHEN open < close THEN 1 ELSE 0 END AS direction, round((close - open) / open, 6) AS magnitude FROM bars)"""


def predictions(spark: S, sf: str) -> D:
    return bars(spark, sf).select("symbol", F.col("bar_date").alias("predict_date"), (F.col("open") < F.col("close")).cast("int").alias("direction"), F.round((F.col("close") - F.col("open")) / F.col("open"), 6).alias("magnitude"))


OUTCOMES = f"""{_PREDICTIONS}, l AS (
  SELECT symbol, bar_date AS predict_date, close AS start_price, coalesce(lead(close, 5) OVER w, last_value(close) OVER e) AS end_price, coalesce(lead(bar_date, 5) OVER w, last_value(bar_date) OVER e) AS actual_date
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_date), e AS (PARTITION BY symbol ORDER BY bar_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), o AS (
  SELECT *, end_price / start_price - 1 AS actual_magnitude, CASE WHEN end_price / start_price - 1 > 0 THEN 1 ELSE 0 END AS actual_direction FROM p JOIN l USING (symbol, predict_date) WHERE predict_date + 7 <= DATE '{AS_OF}'
), acc AS (SELECT *, abs(magnitude - actual_magnitude) AS error_magnitude, CASE WHEN direction = actual_direction THEN 1 ELSE 0 END AS direction_correct FROM o)"""


@query(f"WITH {OUTCOMES} SELECT symbol, predict_date, actual_date, direction, actual_direction, direction_correct, round(actual_magnitude, 6) + 0.0 AS actual_magnitude, round(error_magnitude, 6) + 0.0 AS error_magnitude FROM acc")
def outcome_after(spark: S, sf: str) -> D:
    out = market.outcome_after(predictions(spark, sf), bars(spark, sf), AS_OF)
    return rounded(out.select("symbol", "predict_date", "actual_date", "direction", "actual_direction", "direction_correct", "actual_magnitude", "error_magnitude"))


@query(f"WITH {_PREDICTIONS} SELECT symbol, predict_date FROM p WHERE year(predict_date) >= 1997")
def pending_predictions(spark: S, sf: str) -> D:
    p = predictions(spark, sf)
    return market.pending(p, p.where("predict_date < '1997-01-01'")).select("symbol", "predict_date")


@query(f"""WITH {BARS} SELECT bar_date, a.close AS "close", a.volume AS volume, max(CASE WHEN b.symbol = '2-HIGH' THEN b.close END) AS "global_2-HIGH", max(CASE WHEN b.symbol = '5-LOW' THEN b.close END) AS "global_5-LOW"
FROM (SELECT * FROM bars WHERE symbol = '1-URGENT') a LEFT JOIN bars b USING (bar_date) GROUP BY ALL""")
def market_features(spark: S, sf: str) -> D:
    rows = bars(spark, sf)
    base = rows.where("symbol = '1-URGENT'").select("bar_date", "close", "volume")
    return market.market_features(base, rows.limit(0).select("bar_date"), market.pivot_last(rows, ["2-HIGH", "5-LOW"], "amount"))


_MATCH = f"""{FUND_INDUSTRIES}, {CODES}, {NEWS}, m AS (
  SELECT fund_code, news_id, industry, news.confidence AS match_score FROM (SELECT fund_code, industry, coalesce(industry_code, 'I000') AS industry_code FROM fi LEFT JOIN codes USING (industry) WHERE confidence >= 50) f
  JOIN news USING (industry_code) WHERE classified_at >= DATE '{AS_OF}' - 7)"""


def _matches(spark: S, sf: str) -> D:
    return market.match_news(fund_industries(spark, sf), codes(spark), news(spark, sf), AS_OF)


@query(f"WITH {_MATCH} SELECT * FROM m")
def match_news(spark: S, sf: str) -> D:
    return _matches(spark, sf)


@query(f"WITH {_MATCH} SELECT fund_code, news_id, match_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY fund_code ORDER BY match_score DESC, news_id) AS rank FROM (SELECT fund_code, news_id, max(match_score) AS match_score FROM m GROUP BY ALL)) WHERE rank <= 20")
def best_matches(spark: S, sf: str) -> D:
    return market.best_news_of_funds(fund_industries(spark, sf), codes(spark), news(spark, sf), AS_OF)


_SUMMARY = f"""{_MATCH}, one AS (SELECT fund_code, news_id, max(match_score) AS match_score FROM m GROUP BY ALL), summary AS (
  SELECT fund_code, count(*) AS n_news, count(*) FILTER (match_score >= 0.7) AS n_positive, count(*) FILTER (match_score < 0.4) AS n_negative, avg(match_score) AS avg_score,
    array_to_string(list_slice(list(title ORDER BY match_score DESC, news_id), 1, 5), '|') AS top_titles FROM one JOIN news USING (news_id) GROUP BY fund_code)"""


@query(f"""WITH {_SUMMARY} SELECT fund_code, n_news, n_positive, n_negative, round(avg_score, 6) AS avg_score, top_titles,
  CASE WHEN n_positive > n_negative THEN '偏正面' WHEN n_negative > n_positive THEN '偏负面' ELSE '中性' END AS sentiment, 50 AS advice_confidence FROM summary""")
def news_advice(spark: S, sf: str) -> D:
    rows = news(spark, sf)
    out = market.advice(market.summary_of_funds(fund_industries(spark, sf), codes(spark), rows, rows.select("news_id", "title"), AS_OF))
    return rounded(out.withColumn("top_titles", F.array_join("top_titles", "|")).drop("short_term", "medium_term", "long_term", "risk_level"))


@query(f"WITH {NEWS} SELECT industry_code AS industry, industry_code, count(*) AS n, (2 * sum(CAST(round(confidence * 100) AS BIGINT)) + count(*)) // (2 * count(*)) / 100.0 AS avg_confidence FROM news GROUP BY industry_code")
def industry_stats(spark: S, sf: str) -> D:
    return market.industry_stats(news(spark, sf).withColumn("industry", F.col("industry_code")))


@query(f"WITH {FUND_INDUSTRIES} SELECT fund_code, max_by(industry, (confidence, industry)) AS industry, max(confidence) AS confidence FROM fi GROUP BY fund_code")
def primary_industry(spark: S, sf: str) -> D:
    return market.primary_industry(fund_industries(spark, sf))


@query("SELECT event_type AS kind, 'e' AS origin FROM events UNION ALL SELECT o_orderstatus, 'o' FROM orders")
def union_all(spark: S, sf: str) -> D:
    a = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.lit("e").alias("origin"))
    return a.unionByName(table(spark, sf, "orders").select(F.lit("o").alias("origin"), F.col("o_orderstatus").alias("kind")))


@query("SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def intersect_keys(spark: S, sf: str) -> D:
    orders = table(spark, sf, "orders")
    return orders.where("o_orderstatus = 'O'").select("o_custkey").intersect(orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT url, page_id FROM (SELECT split_part(url, '/', 3) AS url, page_id, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS k FROM pages) WHERE k = 1 AND url <> ''")
def dedup_by_url(spark: S, sf: str) -> D:
    pages = table(spark, sf, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("url"), "page_id")
    return text.dedup_news(pages, "url", "page_id")


@query("""SELECT r_name AS fund, CAST(d AS DATE) AS nav_date, v AS unit_nav FROM (
  SELECT r_name, '2024-01-02' AS d, r_regionkey + 1.5::DOUBLE AS v FROM region UNION ALL SELECT r_name, '2024-01-03', r_regionkey + 2.5::DOUBLE FROM region)""")
def unpivot_dates(spark: S, sf: str) -> D:
    wide = table(spark, sf, "region").select(F.col("r_name").alias("fund"), (F.col("r_regionkey") + F.lit(1.5)).alias("2024-01-02-单位净值"), (F.col("r_regionkey") + F.lit(2.5)).alias("2024-01-03-单位净值"))
    return readers.unpivot_dated(wide, ["fund"])


@query("SELECT s_suppkey AS fund, DATE '2024-01-01' + CAST(s_suppkey % 30 AS INTEGER) AS nav_date, 1.0::DOUBLE + s_suppkey AS unit_nav FROM supplier")
def parse_script_payload(spark: S, sf: str) -> D:
    ms = (F.lit(1704067200000) + F.col("s_suppkey") % 30 * 86_400_000).cast("string")
    script = F.concat(F.lit("var Data_netWorthTrend = [{\"x\":"), ms, F.lit(",\"y\":"), (F.col("s_suppkey") + 1).cast("string"), F.lit("},{\"x\":0,\"y\":0}];"))
    return readers.nav_from_script(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fund"), script.alias("page")), "page")


@query("SELECT s_suppkey AS fund, DATE '2024-02-01' AS nav_date, 2.0::DOUBLE + s_suppkey AS unit_nav, 3.0::DOUBLE AS accum_nav FROM supplier")
def parse_html_table(spark: S, sf: str) -> D:
    html = F.concat(F.lit("<table><tr><th>d</th></tr><tr><td>2024-02-01</td><td>"), (F.col("s_suppkey") + 2).cast("string"), F.lit("</td><td class='a'>3</td></tr></table>"))
    return readers.nav_from_table(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fund"), html.alias("page")), "page")


@query(f"WITH {BARS} SELECT symbol, array_to_string(list(CAST(bar_date AS VARCHAR) ORDER BY bar_date), ',') AS dates, array_to_string(list(CAST(CAST(round(close) AS BIGINT) AS VARCHAR) ORDER BY bar_date), ',') AS closes FROM bars GROUP BY symbol")
def chart_columns(spark: S, sf: str) -> D:
    out = sinks.chart_columns(bars(spark, sf).withColumn("c", F.round("close").cast("long").cast("string")), "symbol", "bar_date", ["c"])
    return out.select("symbol", F.array_join(F.transform("dates", lambda d: d.cast("string")), ",").alias("dates"), F.array_join("c", ",").alias("closes"))


_TITLES = "CASE doc_id % 7 WHEN 0 THEN '央行降息' WHEN 1 THEN '证监会新政策' WHEN 2 THEN '沪指上涨' WHEN 3 THEN '芯片行业突破' WHEN 4 THEN '公司业绩下滑' WHEN 5 THEN 'nothing' END"


def _titled(spark: S, sf: str) -> D:
    return table(spark, sf, "documents").select("doc_id", "source", "text", F.expr(_TITLES).alias("title"))


@query(f"""SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '宏观' WHEN 1 THEN '政策' WHEN 3 THEN '行业' WHEN 4 THEN '公司' ELSE 'general' END AS category,
  industry, CASE WHEN industry = '其他' THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS confidence
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 3 OR regexp_matches(lower(text), 'ai|gpu|cpu') THEN '半导体' WHEN regexp_matches(lower(text), 'cro|cxo') THEN '医药' WHEN regexp_matches(lower(text), 'fintech') THEN '金融' WHEN regexp_matches(lower(text), '5g') THEN 'TMT' ELSE '其他' END AS industry FROM documents)""")
def classify_titles(spark: S, sf: str) -> D:
    rows = _titled(spark, sf)
    found = text.classify(F.col("title"), F.col("text"), text.FUND_INDUSTRIES)
    return rows.select("doc_id", text.first_category(F.col("title")).alias("category"), found.alias("f")).select("doc_id", "category", "f.industry", "f.confidence")


@query(f"""WITH t AS (SELECT doc_id, source, {_TITLES} AS title FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, CASE WHEN doc_id % 7 IN (2) THEN 1 ELSE 0 END + CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END AS u, CASE WHEN doc_id % 7 = 4 THEN 1 ELSE 0 END AS d FROM t)
SELECT source, count(*) AS news_count, CAST(sum(u) AS BIGINT) AS up, CAST(sum(d) AS BIGINT) AS down, coalesce(string_agg(CASE WHEN i <= 5 THEN title END, '；' ORDER BY i), '') AS summary,
  CASE WHEN sum(u) > sum(d) THEN 'bullish' WHEN sum(u) < sum(d) THEN 'bearish' ELSE 'neutral' END AS market_impact FROM k GROUP BY source""")
def news_digest(spark: S, sf: str) -> D:
    return text.digest(_titled(spark, sf), "source", "title", "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '军工' ELSE '其他' END AS industry, CASE WHEN doc_id % 2 = 0 THEN 'I007' ELSE 'I000' END AS industry_code, CASE WHEN doc_id % 2 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM documents""")
def parse_replies(spark: S, sf: str) -> D:
    reply = F.when(F.col("doc_id") % 2 == 0, 'sure: {"industry": "军工", "industry_code": "I007", "confidence": 0.9} ok').otherwise("no json here")
    rows = table(spark, sf, "documents").select("doc_id", text.parse_classification(reply).alias("p"))
    return rows.select("doc_id", "p.industry", "p.industry_code", "p.confidence")


@query("SELECT s_suppkey AS fund_code, CASE s_suppkey % 3 WHEN 0 THEN '新能源' WHEN 1 THEN '半导体' ELSE '医药' END AS industry, 2 AS score, 95.0::DOUBLE AS confidence FROM supplier")
def fund_industry_keywords(spark: S, sf: str) -> D:
    words = F.when(F.col("s_suppkey") % 3 == 0, "储能 光伏 基金").when(F.col("s_suppkey") % 3 == 1, "芯片 基金").otherwise("疫苗 中药 基金")
    return text.top_industries(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fund_code"), words.alias("t")), F.col("t"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS statuses FROM orders GROUP BY o_custkey")
def collect_set_per_key(spark: S, sf: str) -> D:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query("SELECT event_id, md5(props) AS h, round(value, 2) + 0.0 AS v FROM events")
def hash_and_round(spark: S, sf: str) -> D:
    return table(spark, sf, "events").select("event_id", F.md5("props").alias("h"), r(F.col("value"), 2).alias("v"))
