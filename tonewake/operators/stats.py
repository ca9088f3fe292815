"""Statistical tests from distributed sufficient statistics; the driver only sees tables of a few rows or k by k matrices."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewake.functions.tails import correlation_p, normal_two_sided, t_two_sided
from tonewake.operators import ranks

SENTIMENT_FEATURES = ["net_sentiment", "sentiment_delta", "qa_divergence", "ceo_sentiment", "analyst_tone", "sentiment_variance", "negative_chunk_pct"]
REDUCED_FEATURES = ["sentiment_delta", "qa_divergence", "analyst_tone"]
CAR_COLUMNS = ["CAR_1d", "CAR_3d", "CAR_5d"]
MIN_PAIRS, MIN_PERIOD, MIN_SECTOR, MIN_TRAIN, MIN_TEST, MIN_RANGE = 30, 50, 100, 100, 50, 200
GAP, VIF_LIMIT = 0.02, 5.0


def long_pairs(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """feature, target, x, y: a row for each pair of columns that are both there."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for f in features for t in targets])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null and y is not null")


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("feature", "target").agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson_r"))


def average_ranks(pairs: DataFrame) -> DataFrame:
    """pair (a number for each feature and target), x and y: the values' average ranks within the pair; see ranks.average_ranks."""
    numbered = pairs.select(F.xxhash64("feature", "target").alias("pair"), "x", "y")
    both = ranks.average_ranks(ranks.average_ranks(numbered, ["pair"], "x", "__x"), ["pair"], "y", "__y")
    return both.select("pair", F.col("__x").alias("x"), F.col("__y").alias("y"))


def spearman(pairs: DataFrame) -> DataFrame:
    names = pairs.select("feature", "target").distinct().withColumn("pair", F.xxhash64("feature", "target"))
    found = average_ranks(pairs).groupBy("pair").agg(F.count("*").alias("n"), F.corr("x", "y").alias("spearman_r"))
    return found.join(names, "pair").select("feature", "target", "n", "spearman_r")


def correlations(df: DataFrame, features: Sequence[str] = SENTIMENT_FEATURES, targets: Sequence[str] = CAR_COLUMNS, least: int = MIN_PAIRS) -> DataFrame:
    """Both correlations with p-values, their gap and a flag for a large one; pairs with too few rows are left out."""
    pairs = long_pairs(df, features, targets)
    found = pearson(pairs).join(spearman(pairs).drop("n"), ["feature", "target"]).where(F.col("n") >= least).collect()  # features x targets
    rows = []
    for r in found:
        pr, sr = (None if v is None or math.isnan(v) else round(v, 6) for v in (r["pearson_r"], r["spearman_r"]))
        gap = None if pr is None or sr is None else round(abs(r["spearman_r"] - r["pearson_r"]), 6)
        p = [None if v is None else round(v, 6) for v in (correlation_p(r["pearson_r"], r["n"]), correlation_p(r["spearman_r"], r["n"]))]
        rows.append((r["feature"], r["target"], r["n"], pr, p[0], sr, p[1], gap, None if gap is None else gap > GAP))
    schema = "feature string, target string, n bigint, pearson_r double, pearson_p double, spearman_r double, spearman_p double, gap double, gap_flag boolean"
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.abs("spearman_r").desc_nulls_last(), "feature", "target")


def bonferroni(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Adds n_tests (all rows), threshold and significant (p strictly below it)."""
    counted = df.crossJoin(F.broadcast(df.agg(F.count("*").alias("n_tests"))))  # one row
    return counted.withColumn("threshold", F.round(F.lit(alpha) / F.col("n_tests"), 8)).withColumn("significant", F.col(p) < F.lit(alpha) / F.col("n_tests"))


# --- least squares


def design(df: DataFrame, target: str, columns: Sequence[str], dummies: str | None = None) -> tuple[DataFrame, list[str]]:
    """Complete cases as an array x (constant, columns, dummies but the first in order) and y; the dummies' values are df's."""
    used = [target, *columns, *([dummies] if dummies else [])]
    levels = sorted(r[0] for r in df.select(dummies).where(F.col(dummies).isNotNull()).distinct().collect())[1:] if dummies else []
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], *[(F.col(dummies) == v).cast("double") for v in levels]]
    rows = df.dropna(subset=used).select(F.array(*x).alias("x"), F.col(target).cast("double").alias("y"))
    return rows, ["const", *columns, *[f"{dummies}_{v}" for v in levels]]


def gram(rows: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'X, X'y, y'y, the sum of y, n: one aggregation."""
    x = [F.col("x")[i] for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    r = rows.agg(*[F.sum(x[i] * x[j]) for i, j in cells], *[F.sum(v * F.col("y")) for v in x], F.sum(F.col("y") * F.col("y")), F.sum("y"), F.count("*")).first()
    xx = np.zeros((k, k))
    for (i, j), v in zip(cells, r[: len(cells)], strict=True):
        xx[i, j] = xx[j, i] = v or 0.0
    return xx, np.array([v or 0.0 for v in r[len(cells) : len(cells) + k]]), r[-3] or 0.0, r[-2] or 0.0, r[-1]


def vif(xx: np.ndarray) -> np.ndarray:
    """Variance inflation without the constant, against uncentred fits: the diagonals of the moments and their inverse."""
    inner = xx[1:, 1:]
    return np.diag(inner) * np.diag(np.linalg.pinv(inner))


def regression(df: DataFrame, target: str, features: Sequence[str], controls: Sequence[str] = (), dummies: str | None = "sector") -> dict:
    """OLS with HC3 errors: a coefficient table (DataFrame), n, r_squared, adj_r_squared.  Statistics use the normal tail."""
    rows, names = design(df, target, [*features, *controls], dummies)
    k = len(names)
    xx, xy, yy, sy, n = gram(rows, k)
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    x = [F.col("x")[i] for i in range(k)]
    fit: Column = sum((F.lit(float(b)) * v for b, v in zip(beta, x, strict=True)), F.lit(0.0))
    lever: Column = sum((F.lit(float(inverse[i, j] * (1 if i == j else 2))) * x[i] * x[j] for i in range(k) for j in range(i, k)), F.lit(0.0))
    # a row that its own dummy fits has leverage 1 and no residual, so 0 / 0: it tells nothing of the errors
    scored = rows.withColumn("__room", 1 - lever).withColumn("w", F.when(F.col("__room") > 1e-9, F.pow((F.col("y") - fit) / F.col("__room"), 2)).otherwise(0.0))
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    r = scored.agg(*[F.sum(F.col("w") * x[i] * x[j]) for i, j in cells]).first()
    meat = np.zeros((k, k))
    for (i, j), v in zip(cells, r, strict=True):
        meat[i, j] = meat[j, i] = v or 0.0
    errors = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
    inflation = [None, *vif(xx).tolist()]
    table = []
    for name, b, e, v in zip(names, beta.tolist(), errors.tolist(), inflation, strict=True):
        t = b / e if e else None
        table.append((name, b, e, t, None if t is None else normal_two_sided(t), b - 1.959964 * e, b + 1.959964 * e, v, None if v is None else v > VIF_LIMIT))
    rank = int(np.linalg.matrix_rank(xx))
    total = yy - sy * sy / n if n else 0.0
    r2 = 1 - (yy - beta @ xy) / total if total else None
    adjusted = 1 - (1 - r2) * (n - 1) / (n - rank) if r2 is not None and n > rank else None
    schema = "variable string, coef double, std_err double, t_stat double, p_value double, ci_low double, ci_high double, vif double, vif_flag boolean"
    return {"table": df.sparkSession.createDataFrame(table, schema), "n": n, "r_squared": r2, "adj_r_squared": adjusted}


# --- quantiles


def edges(df: DataFrame, feature: str, n: int, by: str | None = None) -> DataFrame:
    """Interpolated quantile edges, with the number of rows; of each group where by is given."""
    return ranks.quantiles(df, feature, [i / n for i in range(n + 1)], [by] if by else [])


def bin_of(x: Column, bounds: Column, n: int) -> Column:
    """Right-closed bins 1 to n; values beyond the ends go to the end bins."""
    return sum(((F.get(bounds, F.lit(k)) < x).cast("int") for k in range(1, n)), F.lit(1))


def binned(df: DataFrame, feature: str, target: str, n: int = 4, by: str | None = None, least: int = 0) -> DataFrame:
    """Complete rows with their quantile, of the whole or of each group; groups with too few rows or equal edges are left out."""
    rows = df.dropna(subset=[feature, target, *([by] if by else [])])
    table = edges(rows, feature, n, by).where((F.col("n") >= least) & (F.size(F.array_distinct("edges")) == n + 1)).drop("n")
    joined = rows.join(table, by) if by else rows.crossJoin(F.broadcast(table))  # one row of edges
    return joined.withColumn("quantile", bin_of(F.col(feature).cast("double"), F.col("edges"), n)).drop("edges")


def quantile_summary(df: DataFrame, feature: str, target: str, n: int = 4) -> DataFrame:
    """Size, mean, deviation, least, median and greatest target of each quantile.  Equal edges raise, as there are no n bins."""
    rows = df.dropna(subset=[feature, target])
    found = edges(rows, feature, n).first()
    if found is not None and len(set(found["edges"])) != n + 1:
        raise ValueError("quantile edges are not distinct")
    placed = rows.withColumn("quantile", bin_of(F.col(feature).cast("double"), F.array(*[F.lit(e) for e in found["edges"]]), n)) if found else binned(df, feature, target, n)
    t = F.col(target)
    plain = placed.groupBy("quantile").agg(F.count("*").alias("n"), F.avg(t).alias("mean"), F.stddev_samp(t).alias("std"), F.min(t).alias("min"), F.max(t).alias("max"))
    middle = ranks.quantiles(placed, target, [0.5], ["quantile"]).select("quantile", F.get("edges", F.lit(0)).alias("median"))
    return plain.join(middle, "quantile").select("quantile", "n", "mean", "std", "min", "median", "max")


def welch(top_mean, top_var, top_n, low_mean, low_var, low_n) -> tuple[Column, Column]:
    """t and Satterthwaite's degrees of freedom, of columns."""
    a, b = top_var / top_n, low_var / low_n
    return F.try_divide(top_mean - low_mean, F.sqrt(a + b)), F.try_divide((a + b) * (a + b), a * a / (top_n - 1) + b * b / (low_n - 1))


def spread(rows: DataFrame, target: str, n: int = 4, by: str | None = None) -> DataFrame:
    """Top less bottom quantile: means, spread, Welch's t and its degrees of freedom, for all or each group."""
    t = F.col(target)
    top, low = F.when(F.col("quantile") == n, t), F.when(F.col("quantile") == 1, t)
    stats = [f(c).alias(f"{side}_{name}") for side, c in (("top", top), ("bottom", low)) for name, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))]
    grouped = rows.groupBy(*([by] if by else [])).agg(*stats, F.count("*").alias("n_rows"))
    tt, dof = welch(F.col("top_mean"), F.col("top_var"), F.col("top_n"), F.col("bottom_mean"), F.col("bottom_var"), F.col("bottom_n"))
    keys = [by] if by else []
    return grouped.select(*keys, "n_rows", "top_n", "bottom_n", "top_mean", "bottom_mean", (F.col("top_mean") - F.col("bottom_mean")).alias("spread"), tt.alias("t_stat"), dof.alias("df"))


def with_p(spreads: DataFrame) -> DataFrame:
    """A spread table of a few rows with p_value and significant."""
    rows = [(*r, None if p is None else round(p, 6), None if p is None else p < 0.05) for r in spreads.collect() for p in [t_two_sided(r["t_stat"], r["df"])]]
    return spreads.sparkSession.createDataFrame(rows, spreads.schema.add("p_value", "double").add("significant", "boolean"))


def spread_by_period(df: DataFrame, feature: str, target: str, period: Column, n: int = 4) -> DataFrame:
    """Each period by its own edges; n_events are the rows of the end quantiles."""
    out = spread(binned(df.withColumn("period", period), feature, target, n, "period", MIN_PERIOD), target, n, "period")
    return out.withColumn("n_events", F.col("top_n") + F.col("bottom_n"))


def spread_by_sector(df: DataFrame, feature: str, target: str, sector: str = "sector", n: int = 4) -> DataFrame:
    """Each sector by its own edges, widest spread first; n_events are all complete rows."""
    if sector not in df.columns:
        raise ValueError(f"no column {sector}")
    out = spread(binned(df, feature, target, n, sector, MIN_SECTOR), target, n, sector)
    return out.withColumn("n_events", F.col("n_rows")).orderBy(F.col("spread").desc(), sector)


def sector_spread_in_years(df: DataFrame, feature: str, target: str, first: int, last: int, least: int = MIN_RANGE) -> DataFrame:
    """Sectors' spreads over the years first to last, inclusive; no rows where fewer than least complete rows are in them."""
    chosen = df.where(F.year("date").between(first, last) & F.col("sector").isNotNull())
    enough = chosen.dropna(subset=[feature, target]).agg((F.count("*") >= least).alias("__enough"))
    return spread_by_sector(chosen.crossJoin(F.broadcast(enough)).where("__enough").drop("__enough"), feature, target)  # one row


def regression_table(df: DataFrame, targets: Sequence[str] = CAR_COLUMNS, features: Sequence[str] = REDUCED_FEATURES, controls: Sequence[str] = ("log_market_cap",), models: Sequence[str] = ("A", "B")) -> DataFrame:
    """target, model (A without controls, B with), variable, coef, p_value: the features' rows of each regression of the models."""
    rows = []
    for target in targets:
        for model in models:
            for r in regression(df, target, features, {"A": (), "B": controls}[model])["table"].collect():  # a row for each variable
                if r["variable"] in features:
                    rows.append((target, model, r["variable"], r["coef"], r["p_value"]))
    return df.sparkSession.createDataFrame(rows, "target string, model string, variable string, coef double, p_value double")


def significance_pools(correlation: DataFrame, regressions: DataFrame) -> DataFrame:
    """pool, name, p_value and Bonferroni's columns: rank correlations and regression coefficients, each a pool of its own."""
    one = correlation.select(F.concat_ws("/", "feature", "target").alias("name"), F.col("spearman_p").alias("p_value"))
    two = regressions.select(F.concat_ws("/", "variable", "target", "model").alias("name"), "p_value")
    pools = [bonferroni(d).withColumn("pool", F.lit(p)) for p, d in (("correlation", one), ("regression", two))]
    return pools[0].unionByName(pools[1])


def out_of_sample(df: DataFrame, feature: str, target: str, train: Column, n: int = 4) -> DataFrame:
    """The other rows in the training rows' bins."""
    rows = df.dropna(subset=[feature, target])
    sizes = rows.agg(F.sum(F.when(train, 1).otherwise(0)), F.sum(F.when(train, 0).otherwise(1))).first()
    if (sizes[0] or 0) < MIN_TRAIN or (sizes[1] or 0) < MIN_TEST:
        raise ValueError(f"{sizes[0] or 0} training and {sizes[1] or 0} test rows")
    table = edges(rows.where(train), feature, n).select("edges")
    return rows.where(~train).crossJoin(F.broadcast(table)).withColumn("quantile", bin_of(F.col(feature).cast("double"), F.col("edges"), n)).drop("edges")


def strategy_robustness(df: DataFrame, overlap_features: DataFrame) -> DataFrame:
    """feature, nonoverlap_r, overlap_r, difference: both chunking strategies' rank correlations with the 3-day return."""
    left = spearman(long_pairs(df, SENTIMENT_FEATURES, ["CAR_3d"])).where(F.col("n") >= MIN_PAIRS)
    joined = overlap_features.join(df.select("ticker", "date", "CAR_3d"), ["ticker", "date"])
    right = spearman(long_pairs(joined, SENTIMENT_FEATURES, ["CAR_3d"])).where(F.col("n") >= MIN_PAIRS)
    both = left.select("feature", F.col("spearman_r").alias("nonoverlap_r")).join(right.select("feature", F.col("spearman_r").alias("overlap_r")), "feature")
    return both.withColumn("difference", F.col("overlap_r") - F.col("nonoverlap_r"))


def robustness(df: DataFrame, overlap_features: DataFrame) -> dict:
    """Market- against beta-adjusted regressions, and strategy_robustness()."""
    reduced = [c for c in REDUCED_FEATURES if c in df.columns]
    plain, adjusted = (regression(df, t, reduced) for t in ("CAR_3d", "beta_CAR_3d"))
    return {"market": plain, "beta": adjusted, "strategies": strategy_robustness(df, overlap_features)}
