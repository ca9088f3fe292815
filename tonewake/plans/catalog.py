"""The registered queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewake.functions import text as X
from tonewake.operators import features, market, reports, scoring, stats, transcripts, validate
from tonewake.plans import analysis as A
from tonewake.plans import tables as D
from tonewake.plans import text_sql as Q
from tonewake.sources.scratch import cut

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "bigint", "smallint") else F.col(c) for c, t in df.dtypes])


# --- features

_AGG = """ agg AS (SELECT ticker, date, avg(positive_prob) AS mean_positive, avg(negative_prob) AS mean_negative, avg(neutral_prob) AS mean_neutral,
  avg(positive_prob - negative_prob) AS net_sentiment, stddev_samp(positive_prob) AS sentiment_variance, max(positive_prob) AS max_positive, min(positive_prob) AS min_positive, count(positive_prob) AS chunk_count,
  avg(positive_prob - negative_prob) FILTER (source_section = 'prepared_remarks') AS prepared_net, avg(positive_prob - negative_prob) FILTER (source_section = 'qa_session') AS qa_net,
  avg(positive_prob - negative_prob) FILTER (role = 'ceo') AS ceo_sentiment, avg(positive_prob - negative_prob) FILTER (role = 'cfo') AS cfo_sentiment, avg(positive_prob - negative_prob) FILTER (role = 'analyst') AS analyst_tone,
  avg(CASE WHEN negative_prob > 0.5 THEN 1.0 ELSE 0.0 END) AS negative_chunk_pct, count(chunk_text) AS word_count FROM scores GROUP BY 1, 2)"""
_FEATURES = """ features AS (SELECT *, net_sentiment - lag(net_sentiment) OVER (PARTITION BY ticker ORDER BY date) AS sentiment_delta, qa_net - prepared_net AS qa_divergence FROM agg)"""


@query(f"WITH {D.SCORES_SQL}, {_AGG}, {_FEATURES} SELECT ticker, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in features.FEATURES[:-1]) + ", chunk_count FROM features")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.feature_matrix(D.scores(spark, sf_dir)))


@query(f"WITH {D.SCORES_SQL}, {_AGG} SELECT ticker, date, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mean_positive", "mean_negative", "mean_neutral", "net_sentiment", "sentiment_variance", "max_positive", "min_positive", "prepared_net", "qa_net")) + ", chunk_count FROM agg")
def transcript_sentiment(spark, sf_dir):
    df = features.transcript_aggregates(D.scores(spark, sf_dir))
    return rounded(df.select("ticker", "date", "mean_positive", "mean_negative", "mean_neutral", "net_sentiment", "sentiment_variance", "max_positive", "min_positive", "prepared_net", "qa_net", "chunk_count"))


@query(f"WITH {D.SCORES_SQL}, {_AGG} SELECT ticker, date, round(qa_net - prepared_net, 6) AS qa_divergence, round(ceo_sentiment, 6) AS ceo_sentiment, round(cfo_sentiment, 6) AS cfo_sentiment, round(analyst_tone, 6) AS analyst_tone FROM agg")
def divergence_features(spark, sf_dir):
    return rounded(features.transcript_aggregates(D.scores(spark, sf_dir)).select("ticker", "date", "qa_divergence", "ceo_sentiment", "cfo_sentiment", "analyst_tone"))


@query(f"WITH {D.SCORES_SQL}, {_AGG} SELECT ticker, date, word_count, chunk_count, round(negative_chunk_pct, 6) AS negative_chunk_pct, round(sentiment_variance, 6) AS sentiment_variance FROM agg")
def linguistic_features(spark, sf_dir):
    return rounded(features.transcript_aggregates(D.scores(spark, sf_dir)).select("ticker", "date", "word_count", "chunk_count", "negative_chunk_pct", "sentiment_variance"))


@query(f"WITH {D.SCORES_SQL}, {_AGG}, {_FEATURES} SELECT ticker, date, round(sentiment_delta, 6) AS sentiment_delta FROM features WHERE sentiment_delta IS NOT NULL")
def sentiment_delta(spark, sf_dir):
    return rounded(features.feature_matrix(D.scores(spark, sf_dir)).select("ticker", "date", "sentiment_delta").where("sentiment_delta is not null"))


@query(f"WITH {D.SCORES_SQL} SELECT overlap, source_section, count(*) AS n FROM scores GROUP BY 1, 2")
def strategy_split(spark, sf_dir):
    s = D.scores(spark, sf_dir)
    return reports.per_group(s.where(~F.col("overlap")).unionByName(s.where("overlap")), "overlap", "source_section")


# --- returns

_CAR, _FRAMES = A.CAR_SQL, A.FRAMES_SQL


@query(f"WITH {D.MARKET_SQL} SELECT ticker, day, round(close, 9) AS close FROM prices")
def price_panel(spark, sf_dir):
    p = D.prices(spark, sf_dir)
    return p.select("ticker", "day", F.round("close", 9).alias("close"))


@query(f"WITH {D.MARKET_SQL} SELECT day, CAST(pos AS BIGINT) AS pos FROM cal")
def calendar(spark, sf_dir):
    return rounded(market.calendar(D.prices(spark, sf_dir)))


def _started(spark, sf_dir):
    p = cut(D.prices(spark, sf_dir), "prices")  # read by the calendar, the benchmark and the returns
    return market.with_start(D.calls(spark, sf_dir), market.calendar(p)), p


@query(
    f"WITH {D.MARKET_SQL} SELECT event_id, CAST(start_pos AS BIGINT) AS start_pos, "
    + ", ".join(f"CAST(CASE WHEN start_pos IS NULL THEN NULL WHEN start_pos + {w - 1} <= last_pos THEN {w} ELSE 0 END AS BIGINT) AS days_{w}" for w in market.WINDOWS)
    + " FROM started"
)
def event_window(spark, sf_dir):
    made = market.event_windows(_started(spark, sf_dir)[0])
    return rounded(made.select("event_id", "start_pos", *[F.when(F.col(f"window_{w}d").isNotNull(), F.size(f"window_{w}d")).alias(f"days_{w}") for w in market.WINDOWS]))


@query(
    f"WITH {D.MARKET_SQL}, cars AS (SELECT ticker, pos, {_CAR} FROM daily WINDOW {_FRAMES}) SELECT event_id, "
    + ", ".join(f"round(car_{w}, 6) AS CAR_{w}d" for w in market.WINDOWS)
    + " FROM started LEFT JOIN cars ON started.ticker = cars.ticker AND started.start_pos = cars.pos"
)
def car(spark, sf_dir):
    started, p = _started(spark, sf_dir)
    daily = market.daily_returns(p, market.calendar(p), D.benchmark_prices(p))
    return rounded(market.abnormal_returns(started, daily).select("event_id", "CAR_1d", "CAR_3d", "CAR_5d"))


@query(
    f"""WITH {D.MARKET_SQL},
 {A.BETAS_SQL},
 sums AS (SELECT ticker, pos, {A.SUMS_SQL}"""
    + f" FROM daily WINDOW {_FRAMES}) SELECT event_id, round(beta, 4) AS beta, "
    + ", ".join(f"round(s{w} - beta * m{w}, 6) AS beta_CAR_{w}d" for w in market.WINDOWS)
    + " FROM started LEFT JOIN betas ON started.ticker = betas.ticker AND started.start_pos = betas.start_pos LEFT JOIN sums ON started.ticker = sums.ticker AND started.start_pos = sums.pos"
)
def beta_car(spark, sf_dir):
    started, p = _started(spark, sf_dir)
    daily = market.daily_returns(p, market.calendar(p), D.benchmark_prices(p))
    return rounded(market.beta_abnormal_returns(started, daily).select("event_id", "beta", "beta_CAR_1d", "beta_CAR_3d", "beta_CAR_5d"))


@query(f"WITH {D.MARKET_SQL}, cars AS (SELECT ticker, pos, {_CAR} FROM daily WINDOW {_FRAMES}) SELECT count(*) AS n_rows, CAST(sum(CASE WHEN car_1 IS NOT NULL AND car_3 IS NOT NULL AND car_5 IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_complete FROM started LEFT JOIN cars ON started.ticker = cars.ticker AND started.start_pos = cars.pos")
def car_completeness(spark, sf_dir):
    started, p = _started(spark, sf_dir)
    daily = market.daily_returns(p, market.calendar(p), D.benchmark_prices(p))
    return rounded(reports.completeness(market.abnormal_returns(started, daily), ["CAR_1d", "CAR_3d", "CAR_5d"]))


@query(A.READY)
def analysis_ready(spark, sf_dir):
    return A.shown(A.ready(spark, sf_dir))


@query(f"WITH {A.ANALYSIS} SELECT ticker, date, sector, round(market_cap, 6) AS market_cap, round(log_market_cap, 6) AS log_market_cap, round(CAR_3d, 6) AS CAR_3d FROM ready")
def company_join(spark, sf_dir):
    return A.shown(A.ready(spark, sf_dir)).select("ticker", "date", "sector", "market_cap", "log_market_cap", "CAR_3d")


@query(f"WITH {A.ANALYSIS}, c AS ({A.correlations_sql('ready', stats.SENTIMENT_FEATURES, stats.CAR_COLUMNS)}) SELECT (SELECT count(ticker) FROM ready) + 1213 AS n_transcripts, (SELECT count(DISTINCT ticker) FROM ready) AS n_companies, (SELECT year(min(date)) FROM ready) AS first_year, (SELECT year(max(date)) FROM ready) AS last_year, feature AS top_feature, target AS top_target, spearman_r FROM c ORDER BY abs(spearman_r) DESC, feature, target LIMIT 1")
def overview(spark, sf_dir):
    df = A.ready(spark, sf_dir)
    return rounded(reports.overview(df, stats.correlations(df), 1213))


@query(f"WITH {A.ANALYSIS} {A.correlations_sql('ready', stats.SENTIMENT_FEATURES, stats.CAR_COLUMNS)}")
def signal_correlations(spark, sf_dir):
    return stats.correlations(A.ready(spark, sf_dir))


@query(f"WITH {A.ANALYSIS} SELECT date, round(CAR_3d, 6) AS car, CAR_3d >= 0 AS gain FROM ready WHERE ticker = 'T7' AND CAR_3d IS NOT NULL")
def company_bars(spark, sf_dir):
    return rounded(reports.company_bars(A.ready(spark, sf_dir), "T7", "CAR_3d"))


@query(f"WITH {A.ANALYSIS} SELECT ticker, date, CAST(year(date) AS BIGINT) AS year, year(date) || 'Q' || quarter(date) AS quarter, round(log_market_cap, 6) AS log_market_cap FROM ready")
def analysis_periods(spark, sf_dir):
    return rounded(reports.with_periods(A.ready(spark, sf_dir)).select("ticker", "date", "year", "quarter", "log_market_cap"))


@query("SELECT p_partkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM (SELECT p_partkey, CAST(p_partkey * 37 % 997 AS DOUBLE) / 9970 AS p FROM part)")
def stars(spark, sf_dir):
    p = (F.col("p_partkey") * 37 % 997).cast("double") / 9970
    return D.table(spark, sf_dir, "part").select("p_partkey", X.stars(p).alias("stars"))


_SECTOR_RANGE = f"rows AS (SELECT sentiment_delta AS feature, CAR_1d AS target, sector FROM ready WHERE year(date) BETWEEN 1996 AND 1998 AND sector IS NOT NULL AND sentiment_delta IS NOT NULL AND CAR_1d IS NOT NULL)"


@query(f"WITH {A.ANALYSIS}, {_SECTOR_RANGE}, edges AS (SELECT sector, quantile_cont(feature, 0.25) AS e1, quantile_cont(feature, 0.5) AS e2, quantile_cont(feature, 0.75) AS e3 FROM rows GROUP BY 1), b AS (SELECT rows.*, 1 + (e1 < feature)::INT + (e2 < feature)::INT + (e3 < feature)::INT AS q FROM rows JOIN edges ON rows.sector = edges.sector) SELECT sector, count(*) AS n_events, round(avg(target) FILTER (q = 4) - avg(target) FILTER (q = 1), 6) AS spread FROM b WHERE (SELECT count(*) FROM rows) >= 200 GROUP BY 1 HAVING count(*) >= 100")
def sector_in_range(spark, sf_dir):
    return rounded(stats.sector_spread_in_years(A.ready(spark, sf_dir), "sentiment_delta", "CAR_1d", 1996, 1998).select("sector", "n_events", "spread"))


@query(f"WITH {A.ANALYSIS}, one AS ({A.ranks_sql('ready', stats.SENTIMENT_FEATURES, 'CAR_3d')}), both_ AS (SELECT wide.*, CAR_3d FROM wide JOIN ready ON wide.ticker = ready.ticker AND wide.date = ready.date), two AS ({A.ranks_sql('both_', stats.SENTIMENT_FEATURES, 'CAR_3d')}) SELECT one.feature, round(one.spearman_r, 6) AS nonoverlap_r, round(two.spearman_r, 6) AS overlap_r, round(two.spearman_r - one.spearman_r, 6) AS difference FROM one JOIN two ON one.feature = two.feature WHERE one.n >= 30 AND two.n >= 30")
def robustness(spark, sf_dir):
    wide = features.feature_matrix(D.analysis_scores(spark, sf_dir).where("overlap"))
    return rounded(stats.strategy_robustness(A.ready(spark, sf_dir), wide))


def _gain_models(df):
    return stats.regression_table(df, stats.CAR_COLUMNS, ["sentiment_delta"], ["log_market_cap"], models=("B",))


@query(f"WITH {A.ANALYSIS}, " + ", ".join(f"x{w} AS (WITH {A.hc3_sql(f'SELECT CAR_{w}d AS y, sentiment_delta AS a, log_market_cap AS b, sector AS s FROM ready WHERE CAR_{w}d IS NOT NULL AND sentiment_delta IS NOT NULL AND log_market_cap IS NOT NULL AND sector IS NOT NULL', 'sentiment_delta', 'log_market_cap')})" for w in market.WINDOWS) + " " + " UNION ALL ".join(f"SELECT 'CAR_{w}d' AS target, coef, p_value FROM x{w} WHERE variable = 'sentiment_delta'" for w in market.WINDOWS))
def regression_models(spark, sf_dir):
    return rounded(_gain_models(A.ready(spark, sf_dir)).select("target", "coef", "p_value"))


@query(f"WITH {A.ANALYSIS}, c AS ({A.correlations_sql('ready', stats.SENTIMENT_FEATURES, stats.CAR_COLUMNS)}), " + ", ".join(f"x{w} AS (WITH {A.hc3_sql(f'SELECT CAR_{w}d AS y, sentiment_delta AS a, log_market_cap AS b, sector AS s FROM ready WHERE CAR_{w}d IS NOT NULL AND sentiment_delta IS NOT NULL AND log_market_cap IS NOT NULL AND sector IS NOT NULL', 'sentiment_delta', 'log_market_cap')})" for w in market.WINDOWS) + ", p AS (SELECT 'correlation' AS pool, feature || '/' || target AS name, spearman_p AS p FROM c" + "".join(f" UNION ALL SELECT 'regression', 'sentiment_delta/CAR_{w}d/B', p_value FROM x{w} WHERE variable = 'sentiment_delta'" for w in market.WINDOWS) + ") SELECT pool, name, round(p, 6) AS p_value, count(*) OVER (PARTITION BY pool) AS n_tests, round(0.05 / count(*) OVER (PARTITION BY pool), 8) AS threshold, p < 0.05 / count(*) OVER (PARTITION BY pool) AS significant FROM p")
def bonferroni_pools(spark, sf_dir):
    df = A.ready(spark, sf_dir)
    pools = stats.significance_pools(stats.correlations(df), _gain_models(df))
    return pools.select("pool", "name", F.round("p_value", 6).alias("p_value"), "n_tests", "threshold", "significant")


@query(f"WITH {D.SCORES_SQL}, per AS (SELECT ticker, date, source_section, count(*) AS chunks FROM scores GROUP BY 1, 2, 3) SELECT source_section, count(*) AS n, round(median(chunks), 6) AS median, round(avg(chunks), 6) AS mean FROM per GROUP BY 1")
def chunk_counts(spark, sf_dir):
    return rounded(reports.chunk_counts(D.scores(spark, sf_dir)))


@query("SELECT upper('t' || o_custkey) AS ticker, CAST(o_orderdate AS DATE) AS date, '2020-Q' || (o_orderkey % 4 + 1) AS fiscal_quarter, nullif(regexp_extract(o_orderpriority, '^(\\w+)', 1), '') AS exchange, o_orderkey % 3 = 0 AS has_qa_section FROM orders")
def standardise(spark, sf_dir):
    from tonewake.sources import io

    raw, o = D.raw_calls(spark, sf_dir), D.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Prepared."), F.when(F.col("o_orderkey") % 3 == 0, F.lit("\nQuestions and Answers:\nWhy?")).otherwise(F.lit("")))
    rows = raw.join(o, raw["ordinal"] == o["o_orderkey"]).select("date", F.col("o_orderpriority").alias("exchange"), F.concat(F.lit(" 2020-Q"), F.col("o_orderkey") % 4 + 1, F.lit(" ")).alias("q"), "ticker", text.alias("transcript"))
    return io.standardise(rows).drop("transcript_text")


# --- statistics


def _orders(spark, sf_dir):
    o, c = D.table(spark, sf_dir, "orders"), D.table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_acctbal").alias("feature"), F.col("o_totalprice").alias("target"), F.col("o_orderdate").cast("date").alias("date"), F.col("c_mktsegment").alias("sector"))


_ORDERS = "rows AS (SELECT c_acctbal AS feature, o_totalprice AS target, CAST(o_orderdate AS DATE) AS date, c_mktsegment AS sector FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal IS NOT NULL AND o_totalprice IS NOT NULL)"


def _edges_sql(by: str = "") -> str:
    q = ", ".join(f"quantile_cont(CAST(feature AS DOUBLE), {q}) AS e{i}" for i, q in enumerate((0.25, 0.5, 0.75), 1))
    return f"edges AS (SELECT {by + ', ' if by else ''}{q} FROM rows{' GROUP BY 1' if by else ''})"


_BIN = "CAST(1 + (e1 < feature)::INT + (e2 < feature)::INT + (e3 < feature)::INT AS BIGINT)"
_SPREAD = """top_n, bottom_n, round(top_mean, 4) AS top_mean, round(bottom_mean, 4) AS bottom_mean, round(top_mean - bottom_mean, 4) AS spread,
 round((top_mean - bottom_mean) / sqrt(top_var / top_n + bottom_var / bottom_n), 6) AS t_stat"""
_SIDES = "count(*) AS n_rows, " + ", ".join(f"avg(target) FILTER (q = {k}) AS {s}_mean, var_samp(target) FILTER (q = {k}) AS {s}_var, count(target) FILTER (q = {k}) AS {s}_n" for s, k in (("top", 4), ("bottom", 1)))


def _spread_columns(df, *keys):
    return rounded(df.select(*keys, "top_n", "bottom_n", F.round("top_mean", 4).alias("top_mean"), F.round("bottom_mean", 4).alias("bottom_mean"), F.round("spread", 4).alias("spread"), "t_stat"))


@query(f"WITH {_ORDERS}, {_edges_sql()}, b AS (SELECT *, {_BIN} AS q FROM rows, edges) SELECT q AS quantile, count(*) AS n, round(avg(target), 4) AS mean, round(stddev_samp(target), 4) AS std, round(min(target), 4) AS min, round(median(target), 4) AS median, round(max(target), 4) AS max FROM b GROUP BY 1")
def quantile_summary(spark, sf_dir):
    return rounded(stats.quantile_summary(_orders(spark, sf_dir), "feature", "target"), 4)


@query(f"WITH {_ORDERS}, {_edges_sql()}, b AS (SELECT *, {_BIN} AS q FROM rows, edges), s AS (SELECT {_SIDES} FROM b) SELECT {_SPREAD} FROM s")
def quantile_spread(spark, sf_dir):
    return _spread_columns(stats.spread(stats.binned(_orders(spark, sf_dir), "feature", "target"), "target"))


@query(f"WITH {_ORDERS.replace('AS (SELECT', 'AS (SELECT year(o_orderdate) AS period,', 1)}, {_edges_sql('period')}, b AS (SELECT rows.*, {_BIN} AS q FROM rows JOIN edges ON rows.period = edges.period), s AS (SELECT period, {_SIDES} FROM b GROUP BY 1 HAVING count(*) >= 50) SELECT CAST(period AS BIGINT) AS period, top_n + bottom_n AS n_events, {_SPREAD} FROM s")
def quantile_by_period(spark, sf_dir):
    return _spread_columns(stats.spread_by_period(_orders(spark, sf_dir), "feature", "target", F.year("date")), "period", "n_events")


@query(f"WITH {_ORDERS}, {_edges_sql('sector')}, b AS (SELECT rows.*, {_BIN} AS q FROM rows JOIN edges ON rows.sector = edges.sector), s AS (SELECT sector, {_SIDES} FROM b GROUP BY 1 HAVING count(*) >= 100) SELECT sector, n_rows AS n_events, {_SPREAD} FROM s")
def quantile_by_segment(spark, sf_dir):
    return _spread_columns(stats.spread_by_sector(_orders(spark, sf_dir), "feature", "target"), "sector", "n_events")


@query(f"WITH {_ORDERS}, {_edges_sql().replace('FROM rows', 'FROM rows WHERE year(date) <= 1996')}, b AS (SELECT *, {_BIN} AS q FROM rows, edges WHERE year(date) > 1996) SELECT q AS quantile, count(*) AS n, round(avg(target), 4) AS mean, round(stddev_samp(target), 4) AS std FROM b GROUP BY 1")
def oos_bins(spark, sf_dir):
    b = stats.out_of_sample(_orders(spark, sf_dir), "feature", "target", F.year("date") <= 1996)
    return rounded(b.groupBy("quantile").agg(F.count("*").alias("n"), F.avg("target").alias("mean"), F.stddev_samp("target").alias("std")), 4)


@query(f"WITH {_ORDERS}, {_edges_sql()}, b AS (SELECT *, {_BIN} AS q FROM rows, edges) SELECT q AS quantile, count(*) AS n, round(avg(target), 4) AS mean, round(stddev_samp(target) / sqrt(count(*)) * 1.96, 4) AS half_width FROM b GROUP BY 1")
def quantile_means(spark, sf_dir):
    return rounded(reports.means_with_interval(stats.binned(_orders(spark, sf_dir), "feature", "target"), "target"), 4)


_LINE = ["l_quantity", "l_discount", "l_tax"]
_PAIRS = "pairs AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, 'l_extendedprice' AS target, {c} AS x, l_extendedprice AS y FROM lineitem WHERE {c} IS NOT NULL AND l_extendedprice IS NOT NULL" for c in _LINE) + ")"
_RANKS = """ranked AS (SELECT feature, target, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM pairs)"""


def _line_pairs(spark, sf_dir):
    return stats.long_pairs(D.table(spark, sf_dir, "lineitem"), _LINE, ["l_extendedprice"])


@query(f"WITH {_PAIRS} SELECT feature, target, count(*) AS n, round(corr(x, y), 6) AS pearson_r FROM pairs GROUP BY 1, 2")
def pearson(spark, sf_dir):
    return rounded(stats.pearson(_line_pairs(spark, sf_dir)))


@query(f"WITH {_PAIRS}, {_RANKS} SELECT feature, target, count(*) AS n, round(corr(rx, ry), 6) AS spearman_r FROM ranked GROUP BY 1, 2")
def spearman(spark, sf_dir):
    return rounded(stats.spearman(_line_pairs(spark, sf_dir)))


@query(f"{A.correlations_sql('lineitem', _LINE, ['l_extendedprice'])}")
def correlation_table(spark, sf_dir):
    return stats.correlations(D.table(spark, sf_dir, "lineitem"), _LINE, ["l_extendedprice"])


@query(f"WITH {_PAIRS}, c AS (SELECT feature, corr(x, y) AS r FROM pairs GROUP BY 1) SELECT * FROM (PIVOT (SELECT 'l_extendedprice' AS target, feature, round(r, 6) AS r FROM c) ON target IN ('l_extendedprice') USING first(r) GROUP BY feature)")
def signal_heatmap(spark, sf_dir):
    return rounded(reports.heatmap(stats.pearson(_line_pairs(spark, sf_dir)), "pearson_r", ["l_extendedprice"]))


@query(f"WITH {_PAIRS}, c AS (SELECT feature, target, count(*) AS n, corr(x, y) AS r FROM pairs GROUP BY 1, 2) SELECT feature, target, n, round(r, 6) AS pearson_r FROM c ORDER BY abs(r) DESC LIMIT 1")
def top_signal(spark, sf_dir):
    return rounded(reports.strongest(stats.pearson(_line_pairs(spark, sf_dir)), "pearson_r"))


@query("SELECT p_partkey, round(p, 6) AS p_value, count(*) OVER () AS n_tests, round(0.05 / count(*) OVER (), 8) AS threshold, p < 0.05 / count(*) OVER () AS significant FROM (SELECT p_partkey, CAST(p_partkey * p_partkey % 1000003 AS DOUBLE) / 1000003 AS p FROM part)")
def bonferroni(spark, sf_dir):
    p = D.table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") * F.col("p_partkey") % 1000003).cast("double") / 1000003).alias("p_value"))
    return stats.bonferroni(p).withColumn("p_value", F.round("p_value", 6))


_X = ["l_quantity", "l_discount"]


@query("SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem")
def ols_simple(spark, sf_dir):
    r = stats.regression(D.table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"], dummies=None)
    c = r["table"].agg(F.max(F.when(F.col("variable") == "l_quantity", F.col("coef"))).alias("slope"), F.max(F.when(F.col("variable") == "const", F.col("coef"))).alias("intercept"))
    return c.select(F.lit(r["n"]).cast("bigint").alias("n"), F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round(F.lit(r["r_squared"]), 6).alias("r_squared"))


@query("SELECT round(sum(l_quantity), 2) AS g_const_l_quantity, round(sum(l_discount), 2) AS g_const_l_discount, round(sum(l_quantity * l_quantity), 2) AS g_l_quantity_l_quantity, round(sum(l_quantity * l_discount), 2) AS g_l_quantity_l_discount, round(sum(l_discount * l_discount), 4) AS g_l_discount_l_discount, count(*) AS n FROM lineitem")
def ols_gram(spark, sf_dir):
    rows, names = stats.design(D.table(spark, sf_dir, "lineitem"), "l_extendedprice", _X)
    xx, _, _, _, n = stats.gram(rows, len(names))
    values = {f"g_{names[i]}_{names[j]}": round(float(xx[i, j]), 4 if i == j == 2 else 2) for i in range(3) for j in range(i, 3) if j}
    return spark.createDataFrame([(*values.values(), n)], ", ".join(f"{k} double" for k in values) + ", n bigint")


@query("SELECT 'l_quantity' AS variable, round(sum(l_quantity * l_quantity) * sum(l_discount * l_discount) / (sum(l_quantity * l_quantity) * sum(l_discount * l_discount) - sum(l_quantity * l_discount) ** 2), 6) AS vif FROM lineitem UNION ALL SELECT 'l_discount', round(sum(l_quantity * l_quantity) * sum(l_discount * l_discount) / (sum(l_quantity * l_quantity) * sum(l_discount * l_discount) - sum(l_quantity * l_discount) ** 2), 6) FROM lineitem")
def vif(spark, sf_dir):
    r = stats.regression(D.table(spark, sf_dir, "lineitem"), "l_extendedprice", _X, dummies=None)
    return rounded(r["table"].where("vif is not null").select("variable", "vif"))


_HC3 = A.hc3_sql("SELECT l_extendedprice / 1000 AS y, l_quantity AS a, l_tax AS b, l_returnflag AS s FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL AND l_tax IS NOT NULL AND l_returnflag IS NOT NULL", "l_quantity", "l_tax")


@query(f"WITH {_HC3}")
def ols_hc3(spark, sf_dir):
    df = D.table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "sector").withColumn("price", F.col("l_extendedprice") / 1000)
    return rounded(stats.regression(df, "price", ["l_quantity"], ["l_tax"])["table"])


_DOF = "pow(top_var / top_n + bottom_var / bottom_n, 2) / (pow(top_var / top_n, 2) / (top_n - 1) + pow(bottom_var / bottom_n, 2) / (bottom_n - 1))"
_WELCH_T = "((top_mean - bottom_mean) / sqrt(top_var / top_n + bottom_var / bottom_n))"


@query(f"WITH {_ORDERS}, {_edges_sql('sector')}, b AS (SELECT rows.*, {_BIN} AS q FROM rows JOIN edges ON rows.sector = edges.sector), s AS (SELECT sector, {_SIDES} FROM b GROUP BY 1 HAVING count(*) >= 100) SELECT sector, n_rows AS n_events, round({_WELCH_T}, 6) AS t_stat, round({_DOF}, 4) AS df, round({A.t_p(_WELCH_T, _DOF)}, 6) AS p_value, {A.t_p(_WELCH_T, _DOF)} < 0.05 AS significant FROM s")
def welch_significance(spark, sf_dir):
    found = stats.with_p(stats.spread_by_sector(_orders(spark, sf_dir), "feature", "target"))
    return found.select("sector", F.col("n_events").cast("bigint").alias("n_events"), F.round("t_stat", 6).alias("t_stat"), F.round("df", 4).alias("df"), "p_value", "significant")


# --- text


@query("SELECT doc_id, source, lang, length(text) AS length FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, text, doc_id) AS r FROM documents) WHERE r = 1")
def dedup_longest(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    return transcripts.longest_each(transcripts.first_each(d, ["source", "lang", "text"], "doc_id"), ["source", "lang"], "text").select("doc_id", "source", "lang", F.length("text").cast("bigint").alias("length"))


def _as_transcripts(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 90).cast("int"))
    return d.select(F.col("source").alias("ticker"), F.when(F.col("doc_id") % 50 != 0, day).alias("date"), F.col("text").alias("transcript_text"), F.col("text").contains(":").alias("has_qa_section"))


_DOC_SQL = "t AS (SELECT source AS ticker, CASE WHEN doc_id % 50 <> 0 THEN DATE '2020-01-01' + CAST(doc_id % 90 AS INT) END AS date, text AS transcript_text, contains(text, ':') AS has_qa FROM documents)"


@query(f"WITH {_DOC_SQL}, g AS (SELECT ticker, date, count(*) AS n, sum(CASE WHEN trim(coalesce(transcript_text, '')) = '' THEN 1 ELSE 0 END) AS e, sum(CASE WHEN length(transcript_text) < 500 THEN 1 ELSE 0 END) AS s FROM t GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(e) AS BIGINT) AS empty_texts, CAST(sum(CASE WHEN date IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_dates, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows, CAST(sum(CASE WHEN n > 1 AND date IS NOT NULL AND ticker IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS duplicate_groups, CAST(sum(s) AS BIGINT) AS short_texts FROM g")
def validate_transcripts(spark, sf_dir):
    return rounded(validate.validate(_as_transcripts(spark, sf_dir)))


@query(f"WITH {_DOC_SQL} SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT ticker) AS n_tickers, round(avg(length(transcript_text)), 6) AS mean_length, CAST(sum(has_qa::INT) AS BIGINT) AS n_qa, round(avg(has_qa::INT), 6) AS share_qa FROM t")
def load_summary(spark, sf_dir):
    return rounded(validate.load_summary(_as_transcripts(spark, sf_dir)))


@query("SELECT o_orderkey AS ordinal, CAST(o_orderdate AS DATE) AS call_date, CAST(CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE (CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 12 + 1 <> 12 THEN o_orderkey % 12 + 13 WHEN o_orderkey % 2 = 0 AND o_orderkey % 12 + 1 = 12 THEN 0 ELSE o_orderkey % 12 + 1 END) * 60 + o_orderkey % 60 END AS BIGINT) AS minutes FROM orders")
def call_time(spark, sf_dir):
    r = D.raw_calls(spark, sf_dir)
    return rounded(r.select("ordinal", X.parsed_date(X.date_string(F.col("date"))).alias("call_date"), F.coalesce(X.call_minutes(F.col("date")), F.lit(-1)).alias("minutes")))


@query("SELECT 'T' || o_custkey AS ticker, call_date, after_close FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS call_date, CASE WHEN o_orderkey % 5 = 0 THEN true ELSE o_orderkey % 2 = 1 AND o_orderkey % 12 + 1 BETWEEN 4 AND 11 END AS after_close, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS r FROM orders) WHERE r = 1")
def timing_map(spark, sf_dir):
    return transcripts.call_timing(D.raw_calls(spark, sf_dir))


@query(
    f"""WITH {D.TRANSCRIPTS_SQL}, l AS (SELECT conv_id, string_split(transcript_text, chr(10)) AS ls FROM transcripts),
 f AS (SELECT conv_id, ls[1:coalesce(nullif(list_position(list_transform(ls, lambda x: regexp_matches(x, '^(Duration:\\s*\\d+|Call participants:|More \\w+ analysis|All earnings call transcripts)')), true), 0), len(ls) + 1) - 1] AS ls FROM l),
 b AS (SELECT conv_id, ls, CASE WHEN ls[1] = 'Prepared Remarks:' THEN 1 ELSE 0 END AS s FROM f),
 h AS (SELECT conv_id, ls, s, nullif(list_position(list_transform(ls, lambda x: x = 'Questions and Answers:'), true), 0) AS q, list_position(list_transform(ls[s + 11:], lambda x: regexp_matches(x, '^Jo Doe -- Any Bank -- Analyst$')), true) AS a FROM b),
 c AS (SELECT conv_id, ls, s, q, CASE WHEN q IS NULL AND a > 0 THEN a + s + 10 END AS a FROM h)
 SELECT conv_id, CAST(length(trim(array_to_string(ls[s + 1:coalesce(q, a, len(ls) + 1) - 1], chr(10)), ' ' || chr(10) || chr(9) || chr(13))) AS BIGINT) AS prepared_length, CAST(length(trim(array_to_string(ls[coalesce(q + 1, a, len(ls) + 1):], chr(10)), ' ' || chr(10) || chr(9) || chr(13))) AS BIGINT) AS qa_length FROM c"""
)
def sections(spark, sf_dir):
    t = transcripts.with_sections(D.transcripts(spark, sf_dir))
    return rounded(t.select(F.col("ticker").cast("bigint").alias("conv_id"), F.length("prepared_remarks").alias("prepared_length"), F.length("qa_session").alias("qa_length")))


@query(Q.SPEAKERS)
def speakers(spark, sf_dir):
    said = transcripts.with_turns(transcripts.with_sections(D.transcripts(spark, sf_dir)))
    return rounded(said.select("ticker", "source_section", F.posexplode("turns").alias("turn", "t")).select("ticker", "source_section", "turn", "t.speaker", "t.role", F.length("t.text").alias("length")))


@query(Q.CLEAN)
def clean_text(spark, sf_dir):
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(transcripts.cleaned(F.concat(F.lit("Thank you for joining.\n\n\n"), F.coalesce("text", F.lit(""))))).alias("clean_md5"))


@query(Q.CHUNKS)
def chunks(spark, sf_dir):
    return rounded(transcripts.chunk_transcripts(D.transcripts(spark, sf_dir)))


@query("SELECT doc_id, greatest(1, CAST(round(length(text) / 4.5) AS BIGINT)) AS tokens, CAST(len(string_split(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(30), 'g'), chr(30))) AS BIGINT) AS n_sentences FROM documents")
def token_estimates(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    return rounded(d.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), F.size(X.sentences(F.col("text"))).alias("n_sentences")))


@query(Q.NONOVERLAP)
def chunks_nonoverlap(spark, sf_dir):
    said = F.array(F.struct(F.lit("A").alias("speaker"), F.lit("ceo").alias("role"), F.col("text")))
    return rounded(D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(transcripts.chunks_of_turns(said)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.chunk_token_count", F.md5("c.chunk_text").alias("chunk_md5")))


@query(Q.OVERLAP)
def chunks_overlap(spark, sf_dir):
    return rounded(D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(transcripts.overlapping_chunks(F.col("text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.chunk_token_count", F.md5("c.chunk_text").alias("chunk_md5")))


_HITS = {k: "len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: list_contains(['" + "','".join(ws) + "'], x)))" for k, ws in (("p", ("the", "and", "of", "der", "la")), ("n", ("with", "from", "nicht", "pas", "no")))}


@query(f"SELECT doc_id, round(p / (p + n + 1), 6) AS positive_prob, round(n / (p + n + 1), 6) AS negative_prob, round(1 / (p + n + 1), 6) AS neutral_prob FROM (SELECT doc_id, CAST({_HITS['p']} AS DOUBLE) AS p, CAST({_HITS['n']} AS DOUBLE) AS n FROM documents)")
def score_lexicon(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scoring.score_chunks(d, scoring.lexicon(("the", "and", "of", "der", "la"), ("with", "from", "nicht", "pas", "no")), "text")
    return rounded(scored.drop("text"))


# --- reports


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words FROM documents")
def word_count(spark, sf_dir):
    return rounded(D.table(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("words")))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY 1")
def role_counts(spark, sf_dir):
    return reports.per_group(D.table(spark, sf_dir, "conversations"), "role")


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2")
def section_counts(spark, sf_dir):
    return reports.per_group(D.table(spark, sf_dir, "conversations"), "conv_id", "role")


@query("SELECT CAST(floor(o_totalprice / 10000) AS BIGINT) AS bin, count(*) AS n, floor(o_totalprice / 10000) * 10000 AS bin_start FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 3")
def histogram(spark, sf_dir):
    return reports.histogram(D.table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 10000.0)


@query("SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, " + ", ".join(f"round(quantile_cont(CAST(o_totalprice AS DOUBLE), {q}), 4) AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM orders")
def distribution(spark, sf_dir):
    return rounded(reports.distribution(D.table(spark, sf_dir, "orders"), "o_totalprice"), 4)


@query("SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, count(*) AS n FROM orders GROUP BY 1")
def quarter_volume(spark, sf_dir):
    return reports.per_quarter(D.table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date"))


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1")
def latest_dim(spark, sf_dir):
    return reports.latest_known(D.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("WITH b AS (SELECT DISTINCT o_orderkey // 100 * 100 AS s FROM orders WHERE o_orderkey // 100 % 7 <> 3), d AS (SELECT s AS start, s + 100 AS \"end\" FROM b), g AS (SELECT *, coalesce(lag(\"end\") OVER (ORDER BY start), 0) AS expected FROM d) SELECT * FROM g WHERE start <> expected")
def batch_gaps(spark, sf_dir):
    from tonewake.sources.io import batch_gaps as gaps

    start = F.floor(F.col("o_orderkey") / 100).cast("bigint") * 100
    kept = D.table(spark, sf_dir, "orders").where(F.floor(F.col("o_orderkey") / 100) % 7 != 3)  # so that batches are missing
    return gaps(kept.select(start.alias("start"), (start + 100).alias("end")).distinct()).withColumn("expected", F.col("expected").cast("bigint"))


@query("SELECT CAST(sum(1000) AS BIGINT) AS done, CAST(100000 - sum(1000) AS BIGINT) AS remaining, round(CAST((100000 - sum(1000)) * 6.1 AS DOUBLE), 4) AS eta_seconds FROM (SELECT DISTINCT o_orderkey // 1000 FROM orders)")
def batch_progress(spark, sf_dir):
    from tonewake.sources.io import progress

    start = F.floor(F.col("o_orderkey") / 1000).cast("bigint") * 1000
    made = progress(D.table(spark, sf_dir, "orders").select(start.alias("start"), (start + 1000).alias("end")).distinct(), 100000)
    return rounded(made.select("done", "remaining", F.col("eta_seconds").cast("double").alias("eta_seconds")), 4)


@query("SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IS NOT NULL AND o_custkey = (SELECT min(o_custkey) FROM orders) ORDER BY date DESC")
def company_events(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    first = o.agg(F.min("o_custkey")).first()[0]
    df = o.where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderpriority").isNotNull())
    df = df.select(F.col("o_custkey").alias("ticker"), "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("date"))
    return reports.timeline(df, first, newest_first=True).drop("ticker")
