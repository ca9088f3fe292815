"""Queries over the whole analysis table (features, call times, returns, companies), and the statistics on it, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewake.operators import features, market, transcripts
from tonewake.plans import tables as D
from tonewake.sources.scratch import cut

CAR_SQL = ", ".join(f"CASE WHEN count(s - m) OVER f{w} = {w} THEN sum(s - m) OVER f{w} END AS car_{w}" for w in market.WINDOWS)
SUMS_SQL = ", ".join(f"CASE WHEN count(s - m) OVER f{w} = {w} THEN sum(s) OVER f{w} END AS s{w}, CASE WHEN count(s - m) OVER f{w} = {w} THEN sum(m) OVER f{w} END AS m{w}" for w in market.WINDOWS)
FRAMES_SQL = ", ".join(f"f{w} AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)" for w in market.WINDOWS)
BETAS_SQL = """near AS (SELECT e.ticker, e.start_pos, d.pos, d.close, d.market FROM (SELECT DISTINCT ticker, start_pos FROM started WHERE start_pos - 121 >= 1) e JOIN dense d ON d.ticker = e.ticker AND d.pos BETWEEN e.start_pos - 121 AND e.start_pos - 1 AND d.close IS NOT NULL AND d.market IS NOT NULL),
 steps AS (SELECT ticker, start_pos, (close - lag(close) OVER w) / lag(close) OVER w AS s, (market - lag(market) OVER w) / lag(market) OVER w AS m FROM near WINDOW w AS (PARTITION BY ticker, start_pos ORDER BY pos)),
 betas AS (SELECT ticker, start_pos, regr_slope(s, m) AS beta FROM steps GROUP BY 1, 2 HAVING count(*) >= 30)"""

#: The two-sided tails as Simpson's sums: of the normal density up to |t|, and of cos^(v - 1) up to atan(|t| / sqrt(v)).
_WEIGHT = "(CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END)"


def normal_p(t: str) -> str:
    return f"greatest(0, 1 - 2 * list_sum(list_transform(range(0, 2001), lambda j: {_WEIGHT} * exp(-pow(j * least(abs({t}), 40) / 2000, 2) / 2))) * least(abs({t}), 40) / 6000 / sqrt(2 * pi()))"


def t_p(t: str, v: str) -> str:
    top = f"least(atan(abs({t}) / sqrt({v})), 12 / sqrt({v}))"
    return f"greatest(0, 1 - 2 * exp(lgamma(({v} + 1) / 2) - lgamma(({v}) / 2)) / sqrt(pi()) * list_sum(list_transform(range(0, 2001), lambda j: {_WEIGHT} * pow(cos(j * {top} / 2000), ({v}) - 1))) * {top} / 6000)"


def features_sql(name: str, where: str) -> str:
    """The feature matrix of some chunks, as a CTE."""
    net = "avg(positive_prob - negative_prob)"
    return f"""{name} AS (SELECT *, net_sentiment - lag(net_sentiment) OVER (PARTITION BY ticker ORDER BY date) AS sentiment_delta, qa_net - prepared_net AS qa_divergence FROM (SELECT ticker, date, {net} AS net_sentiment, stddev_samp(positive_prob) AS sentiment_variance,
  {net} FILTER (source_section = 'prepared_remarks') AS prepared_net, {net} FILTER (source_section = 'qa_session') AS qa_net, {net} FILTER (role = 'ceo') AS ceo_sentiment, {net} FILTER (role = 'analyst') AS analyst_tone,
  avg(CASE WHEN negative_prob > 0.5 THEN 1.0 ELSE 0.0 END) AS negative_chunk_pct FROM all_scores WHERE {where} GROUP BY 1, 2))"""


_CALLS = "calls AS (SELECT CAST(substr(f.ticker, 2) AS INT) AS ticker, f.date, coalesce(t.after_close, true) AS after_close FROM plain f LEFT JOIN timing t ON f.ticker = t.ticker AND f.date = t.call_date)"
ANALYSIS = f"""{D.ANALYSIS_SCORES_SQL}, {features_sql("plain", "NOT overlap")}, {features_sql("wide", "overlap")}, {D.ANALYSIS_TIMING_SQL}, {D.market_sql(_CALLS)}, {BETAS_SQL},
 cars AS (SELECT ticker, pos, {CAR_SQL}, {SUMS_SQL} FROM daily WINDOW {FRAMES_SQL}),
 found AS (SELECT 'T' || started.ticker AS ticker, started.date, {", ".join(f'car_{w} AS CAR_{w}d, s{w} - beta * m{w} AS beta_CAR_{w}d' for w in market.WINDOWS)}, beta FROM started LEFT JOIN cars ON started.ticker = cars.ticker AND started.start_pos = cars.pos LEFT JOIN betas ON started.ticker = betas.ticker AND started.start_pos = betas.start_pos),
 ready AS (SELECT plain.*, found.* EXCLUDE (ticker, date), c_acctbal AS market_cap, c_mktsegment AS sector, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END AS log_market_cap FROM plain JOIN found ON plain.ticker = found.ticker AND plain.date = found.date LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 25) ON plain.ticker = 'T' || c_custkey)"""

SHOWN = ["net_sentiment", "sentiment_delta", "qa_divergence", "ceo_sentiment", "analyst_tone", "sentiment_variance", "negative_chunk_pct", "CAR_1d", "CAR_3d", "CAR_5d", "beta_CAR_1d", "beta_CAR_3d", "beta_CAR_5d", "market_cap", "log_market_cap"]


def ready(spark, sf_dir) -> DataFrame:
    """The analysis table, stored once for the queries that read it several times."""
    prices = cut(D.analysis_prices(spark, sf_dir), "prices")
    cal = market.calendar(prices)
    daily = market.daily_returns(prices, cal, D.benchmark_prices(prices))

    def with_returns(df: DataFrame) -> DataFrame:
        started = market.with_start(df, cal)
        return market.beta_abnormal_returns(market.abnormal_returns(started, daily), daily).drop("start_pos", "last_pos")

    matrix = features.feature_matrix(D.analysis_scores(spark, sf_dir).where("not overlap"))
    return cut(features.analysis_ready(matrix, transcripts.call_timing(D.analysis_calls(spark, sf_dir)), with_returns, D.analysis_companies(spark, sf_dir)), "analysis")


def shown(df: DataFrame) -> DataFrame:
    return df.select("ticker", "date", *[F.round(c, 6).alias(c) for c in SHOWN], F.round("beta", 4).alias("beta"), "sector")


READY = f"WITH {ANALYSIS} SELECT ticker, date, {', '.join(f'round({c}, 6) AS {c}' for c in SHOWN)}, round(beta, 4) AS beta, sector FROM ready"


def ranks_sql(source: str, columns: list[str], target: str) -> str:
    """CTEs r_* and a row for each column: rank correlation with the target over rows where both are there."""
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, '{target}' AS target, count(*) AS n, corr(x, y) AS pearson_r, corr(rx, ry) AS spearman_r FROM (SELECT {c} AS x, {target} AS y, {rank(c)} AS rx, {rank(target)} AS ry FROM {source} WHERE {c} IS NOT NULL AND {target} IS NOT NULL)" for c in columns)


def correlations_sql(source: str, columns: list[str], targets: list[str]) -> str:
    """A CTE body: correlations, p-values, gap and flag, as the correlation table has them."""
    found = " UNION ALL ".join(ranks_sql(source, columns, t) for t in targets)
    p = lambda r: f"CASE WHEN abs({r}) >= 1 THEN 0 ELSE {t_p(f'({r} * sqrt((n - 2) / (1 - {r} * {r})))', '(n - 2)')} END"
    return f"""SELECT feature, target, n, round(pearson_r, 6) AS pearson_r, round({p('pearson_r')}, 6) AS pearson_p, round(spearman_r, 6) AS spearman_r, round({p('spearman_r')}, 6) AS spearman_p,
 round(abs(spearman_r - pearson_r), 6) AS gap, round(abs(spearman_r - pearson_r), 6) > 0.02 AS gap_flag FROM ({found}) WHERE n >= 30"""


def hc3_sql(rows: str, a: str, b: str) -> str:
    """SQL for y on a constant, columns a and b, and dummies of s but its first value: HC3 errors, normal tails, uncentred VIF.

    rows: SQL of (y, a, b, s), complete.  Demeaning by s leaves two regressors; every coefficient is a weighted sum of y."""
    return f"""r AS ({rows}), means AS (SELECT s, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, row_number() OVER (ORDER BY s) AS k FROM r GROUP BY 1),
 d AS (SELECT r.s, n, y - my AS y, a - ma AS a, b - mb AS b FROM r JOIN means ON r.s = means.s),
 g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM d),
 sol AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ca, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS cb FROM g),
 w AS (SELECT s, n, (bb * a - ab * b) / det AS u, (aa * b - ab * a) / det AS v, CASE WHEN 1 - 1.0 / n - (bb * a * a - 2 * ab * a * b + aa * b * b) / det > 1e-9 THEN pow((y - ca * a - cb * b) / (1 - 1.0 / n - (bb * a * a - 2 * ab * a * b + aa * b * b) / det), 2) ELSE 0 END AS w FROM d, sol),
 levels AS (SELECT m.*, m.my - ca * m.ma - cb * m.mb AS alpha, f.s AS s0, f.n AS n0, f.ma AS ma0, f.mb AS mb0, f.my - ca * f.ma - cb * f.mb AS alpha0 FROM means m, sol, (SELECT * FROM means WHERE k = 1) f),
 raw AS (SELECT sum(a * a) AS raa, sum(b * b) AS rbb FROM r),
 half AS (SELECT sum(CASE WHEN k = 1 THEN r.a * r.a ELSE (r.a - ma) * (r.a - ma) END) AS haa, sum(CASE WHEN k = 1 THEN r.a * r.b ELSE (r.a - ma) * (r.b - mb) END) AS hab, sum(CASE WHEN k = 1 THEN r.b * r.b ELSE (r.b - mb) * (r.b - mb) END) AS hbb FROM r JOIN means ON r.s = means.s),
 without AS (SELECT l.s AS own, sum(CASE WHEN k = 1 OR r.s = l.s THEN r.a * r.a ELSE (r.a - ma) * (r.a - ma) END) AS oaa, sum(CASE WHEN k = 1 OR r.s = l.s THEN r.a * r.b ELSE (r.a - ma) * (r.b - mb) END) AS oab, sum(CASE WHEN k = 1 OR r.s = l.s THEN r.b * r.b ELSE (r.b - mb) * (r.b - mb) END) AS obb FROM (SELECT s FROM means WHERE k > 1) l, r JOIN means ON r.s = means.s GROUP BY 1),
 coefs AS (SELECT '{a}' AS variable, any_value(ca) AS coef, sqrt(sum(u * u * w)) AS std_err, any_value(raa * hbb / (haa * hbb - hab * hab)) AS vif FROM w, sol, raw, half
  UNION ALL SELECT '{b}', any_value(cb), sqrt(sum(v * v * w)), any_value(rbb * haa / (haa * hbb - hab * hab)) FROM w, sol, raw, half
  UNION ALL SELECT 'const', any_value(alpha0), sqrt(sum(pow((w.s = s0)::INT / n0 - ma0 * u - mb0 * v, 2) * w)), NULL FROM w, (SELECT * FROM levels WHERE k = 1)
  UNION ALL SELECT 'sector_' || l.s, any_value(alpha - alpha0), sqrt(sum(pow((w.s = l.s)::INT / l.n - (w.s = s0)::INT / n0 - (l.ma - ma0) * u - (l.mb - mb0) * v, 2) * w)),
   any_value(l.n / (l.n - (pow(l.n * l.ma, 2) * obb - 2 * l.n * l.ma * l.n * l.mb * oab + pow(l.n * l.mb, 2) * oaa) / (oaa * obb - oab * oab))) FROM w, levels l JOIN without ON without.own = l.s WHERE l.k > 1 GROUP BY l.s)
 SELECT variable, round(coef, 6) AS coef, round(std_err, 6) AS std_err, round(coef / std_err, 6) AS t_stat, round({normal_p('(coef / std_err)')}, 6) AS p_value, round(coef - 1.959964 * std_err, 6) AS ci_low, round(coef + 1.959964 * std_err, 6) AS ci_high, round(vif, 6) AS vif, vif > 5 AS vif_flag FROM coefs"""
