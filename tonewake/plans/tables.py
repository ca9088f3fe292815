"""The operators' schemas, filled from the driver's tables: events as scored chunks, line items as prices, orders as calls,
conversations as transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewake.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    e = table(spark, sf_dir, "events")
    part = {"click": ("prepared_remarks", "operator"), "view": ("qa_session", "analyst"), "error": ("prepared_remarks", "ceo"), "signup": ("qa_session", "cfo"), "purchase": ("qa_session", "analyst")}
    section, role = F.lit("prepared_remarks"), F.lit("unknown")
    for kind, (s, r) in part.items():
        section = F.when(F.col("event_type") == kind, s).otherwise(section)
        role = F.when(F.col("event_type") == kind, r).otherwise(role)
    positive = F.abs("value") % 1.0
    negative = (F.abs("value") * 7.0 % 1.0) * (1.0 - positive)
    return e.select(
        F.col("user_id").cast("string").alias("ticker"),
        F.col("ts").cast("date").alias("date"),
        section.alias("source_section"),
        role.alias("role"),
        F.col("event_type").alias("chunk_text"),
        positive.alias("positive_prob"),
        negative.alias("negative_prob"),
        (1.0 - positive - negative).alias("neutral_prob"),
        (F.col("event_id") % 3 == 0).alias("overlap"),
        *more,
    )


SCORES_SQL = """scores AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date,
  CASE WHEN event_type IN ('view','signup','purchase') THEN 'qa_session' ELSE 'prepared_remarks' END AS source_section,
  CASE event_type WHEN 'click' THEN 'operator' WHEN 'view' THEN 'analyst' WHEN 'error' THEN 'ceo' WHEN 'signup' THEN 'cfo' WHEN 'purchase' THEN 'analyst' ELSE 'unknown' END AS role,
  event_type AS chunk_text, p AS positive_prob, n * (1.0::DOUBLE - p) AS negative_prob, 1.0::DOUBLE - p - n * (1.0::DOUBLE - p) AS neutral_prob, event_id % 3 = 0 AS overlap
  FROM (SELECT *, abs(value) % 1.0::DOUBLE AS p, (abs(value) * 7.0::DOUBLE) % 1.0::DOUBLE AS n FROM events))"""


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    joined = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"])
    return joined.groupBy(F.col("s_nationkey").alias("ticker"), F.col("l_shipdate").cast("date").alias("day")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))


def benchmark_prices(p: DataFrame) -> DataFrame:
    return p.groupBy("day").agg(F.avg("close").alias("close"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return joined.select(F.col("o_orderkey").alias("event_id"), F.col("c_nationkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 24 >= 16).alias("after_close"))


_CALLS_SQL = "calls AS (SELECT o_orderkey AS event_id, c_nationkey AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderkey % 24 >= 16 AS after_close FROM orders JOIN customer ON o_custkey = c_custkey)"


def market_sql(calls: str = _CALLS_SQL) -> str:
    """CTEs prices, market, cal, started and daily, for a CTE of calls (ticker, date, after_close)."""
    return f"""prices AS (SELECT s_nationkey AS ticker, CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice / l_quantity) AS close FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
 market AS (SELECT day, avg(close) AS market FROM prices GROUP BY 1),
 cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM market),
 {calls},
 starts AS (SELECT c.date, c.after_close, min(cal.pos) AS start_pos FROM (SELECT DISTINCT date, after_close FROM calls) c JOIN cal ON cal.day >= c.date + CASE WHEN c.after_close THEN 1 ELSE 0 END GROUP BY 1, 2),
 started AS (SELECT calls.*, starts.start_pos, (SELECT max(pos) FROM cal) AS last_pos FROM calls LEFT JOIN starts ON calls.date = starts.date AND calls.after_close = starts.after_close),
 dense AS (SELECT t.ticker, cal.pos, p.close, m.market FROM (SELECT DISTINCT ticker FROM prices) t, cal LEFT JOIN prices p ON p.ticker = t.ticker AND p.day = cal.day LEFT JOIN market m ON m.day = cal.day),
 daily AS (SELECT *, close / lag(close) OVER w - 1 AS s0, (close - lag(close) OVER w) / lag(close) OVER w AS s, (market - lag(market) OVER w) / lag(market) OVER w AS m FROM dense WINDOW w AS (PARTITION BY ticker ORDER BY pos))"""


MARKET_SQL = market_sql()


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript for each conversation: a header line for each turn, a Q&A header and a footer for some."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null")
    title = F.when(F.col("role") == "user", "Jo Doe -- Any Bank -- Analyst").when(F.col("role") == "assistant", "Max Roe -- Chief Executive Officer").otherwise("Operator")
    said = F.concat(title, F.lit("\n"), F.coalesce("text", F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct("turn", said.alias("said"))))
    body = F.array_join(F.transform(turns, lambda t: t["said"]), "\n")
    kind = F.col("conv_id") % 4
    half = F.concat(F.when(kind == 0, F.lit("Prepared Remarks:\n")).otherwise(F.lit("")), body, F.when(kind == 1, F.lit("\nQuestions and Answers:\nOperator\nNext question.\nDuration: 10 minutes\nNo more.")).otherwise(F.lit("")))
    return c.groupBy("conv_id").agg(body.alias("__b"), half.alias("transcript_text")).select(
        F.col("conv_id").cast("string").alias("ticker"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("conv_id") % 300).cast("int")).alias("date"),
        F.concat(F.lit("2020-Q"), (F.col("conv_id") % 4 + 1).cast("string")).alias("fiscal_quarter"),
        F.lit("NYSE").alias("exchange"),
        "transcript_text",
        F.col("transcript_text").contains("Questions and Answers:").alias("has_qa_section"),
    )


TRANSCRIPTS_SQL = r"""said AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Jo Doe -- Any Bank -- Analyst' WHEN 'assistant' THEN 'Max Roe -- Chief Executive Officer' ELSE 'Operator' END || chr(10) || coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
 transcripts AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'Prepared Remarks:' || chr(10) ELSE '' END || string_agg(said, chr(10) ORDER BY turn, said) || CASE WHEN conv_id % 4 = 1 THEN chr(10) || 'Questions and Answers:' || chr(10) || 'Operator' || chr(10) || 'Next question.' || chr(10) || 'Duration: 10 minutes' || chr(10) || 'No more.' ELSE '' END AS transcript_text FROM said GROUP BY conv_id)"""


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date fields as they come: arrays, strings, with and without a time."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format(F.col("o_orderdate"), "MMM d, yyyy")
    hour = (F.col("o_orderkey") % 12 + 1).cast("string")
    minute = F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")
    half = F.when(F.col("o_orderkey") % 2 == 0, " a.m.").otherwise(" p.m.")
    when = F.when(F.col("o_orderkey") % 5 == 0, day).otherwise(F.concat(day, F.lit(", "), hour, F.lit(":"), minute, half, F.lit(" ET")))
    parts = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Some Co (SC 1.2%) Q2 "), when)).otherwise(F.array(when))
    return o.select(F.concat(F.lit(" t"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("ticker"), parts.alias("date"), F.col("o_orderkey").alias("ordinal"))


# --- the analysis table: events as chunks of 25 tickers, nations' prices, orders as calls, customers as companies

def analysis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker and date come with the row itself: a second reading of the events to join them by would double the work."""
    ticker = F.concat(F.lit("T"), F.col("user_id") % 25)
    date = F.date_add(F.lit("1996-01-01").cast("date"), ((F.col("event_id") * 7 % 100) * 15).cast("int"))
    s = scores(spark, sf_dir, ticker.alias("__ticker"), date.alias("__date"))
    return s.drop("ticker", "date").withColumnsRenamed({"__ticker": "ticker", "__date": "date"})


ANALYSIS_SCORES_SQL = f"""{SCORES_SQL.replace("scores AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date", "all_scores AS (SELECT 'T' || (user_id % 25) AS ticker, DATE '1996-01-01' + CAST(((event_id * 7) % 100) * 15 AS INT) AS date")}"""


def analysis_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw calls of the same tickers, on days of theirs."""
    r = raw_calls(spark, sf_dir)
    ticker = F.concat(F.lit(" t"), (F.col("ordinal") % 25).cast("string"))
    day = F.date_format(F.date_add(F.lit("1996-01-01").cast("date"), ((F.col("ordinal") * 7 % 97) * 15).cast("int")), "MMM d, yyyy")
    half = F.when(F.col("ordinal") % 2 == 0, " a.m. ET").otherwise(" p.m. ET")
    when = F.when(F.col("ordinal") % 5 == 0, day).otherwise(F.concat(day, F.lit(", "), (F.col("ordinal") % 12 + 1).cast("string"), F.lit(":05"), half))
    return r.select(ticker.alias("ticker"), F.array(when).alias("date"), "ordinal")


ANALYSIS_TIMING_SQL = """timing AS (SELECT ticker, call_date, after_close FROM (SELECT 'T' || (o_orderkey % 25) AS ticker, DATE '1996-01-01' + CAST(((o_orderkey * 7) % 97) * 15 AS INT) AS call_date,
  CASE WHEN o_orderkey % 5 = 0 THEN true ELSE o_orderkey % 2 = 1 AND o_orderkey % 12 + 1 BETWEEN 4 AND 11 END AS after_close, row_number() OVER (PARTITION BY o_orderkey % 25, (o_orderkey * 7) % 97 ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1)"""


def analysis_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(spark, sf_dir).withColumn("ticker", F.concat(F.lit("T"), F.col("ticker").cast("string")))


def analysis_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey < 25")
    return c.select(F.concat(F.lit("T"), F.col("c_custkey")).alias("ticker"), F.col("c_acctbal").alias("market_cap"), F.col("c_mktsegment").alias("sector"))
