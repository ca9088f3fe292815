"""The tables behind the overview, company and distribution pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewake.functions.text import quarter_label
from tonewake.operators import ranks


def per_group(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def per_quarter(df: DataFrame, day: Column) -> DataFrame:
    return df.where(day.isNotNull()).groupBy(quarter_label(day).alias("quarter")).agg(F.count("*").alias("n"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and rows where all columns are there."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.when(whole, 1).otherwise(0)).alias("n_complete"))


def histogram(df: DataFrame, column: str, low: float, width: float) -> DataFrame:
    b = F.floor((F.col(column) - low) / width).cast("long")
    return df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("bin_start", F.lit(low) + F.col("bin") * width)


def distribution(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation and interpolated percentiles 5, 25, 50, 75, 95 of a column; of each group where by is given."""
    points = (0.05, 0.25, 0.5, 0.75, 0.95)
    middle = ranks.quantiles(df, column, points, by).drop("n")
    plain = df.dropna(subset=[*by]) if by else df
    got = plain.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"))
    joined = got.join(middle, list(by), "left") if by else got.join(F.broadcast(middle), F.lit(True), "left")  # one row each
    return joined.select(*by, "n", "mean", "std", *[F.col("edges")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(points)])


def overview(df: DataFrame, correlation: DataFrame, unlisted: int = 0) -> DataFrame:
    """One row: transcripts (with those that never became events), companies, first and last year, the strongest rank correlation."""
    top = strongest(correlation, "spearman_r").select(F.col("feature").alias("top_feature"), F.col("target").alias("top_target"), "spearman_r")
    counts = df.agg((F.count("ticker") + unlisted).alias("n_transcripts"), F.countDistinct("ticker").alias("n_companies"), F.year(F.min("date")).alias("first_year"), F.year(F.max("date")).alias("last_year"))
    return counts.join(F.broadcast(top), F.lit(True), "left")  # one row each


def chunk_counts(scores: DataFrame) -> DataFrame:
    """For each section: transcripts that have it, and the median and mean of their chunks."""
    per = scores.groupBy("ticker", "date", "source_section").agg(F.count("*").alias("chunks"))
    middle = ranks.quantiles(per, "chunks", [0.5], ["source_section"]).select("source_section", F.get("edges", F.lit(0)).alias("median"))
    return per.groupBy("source_section").agg(F.count("*").alias("n"), F.avg("chunks").alias("mean")).join(middle, "source_section").select("source_section", "n", "median", "mean")


def with_periods(df: DataFrame) -> DataFrame:
    """The analysis table with year, quarter and the logarithm of a positive market cap, as the pages read it."""
    return df.withColumn("year", F.year("date")).withColumn("quarter", quarter_label(F.col("date"))).withColumn("log_market_cap", F.when(F.col("market_cap") > 0, F.ln("market_cap")))


def company_bars(df: DataFrame, ticker: str, window: str) -> DataFrame:
    """The company's events that have the window's return, in order, with its sign."""
    return timeline(df.where(F.col(window).isNotNull()), ticker).select("date", F.col(window).alias("car"), (F.col(window) >= 0).alias("gain"))


def heatmap(correlation: DataFrame, value: str, targets: list[str]) -> DataFrame:
    """Features down, targets across."""
    return correlation.groupBy("feature").pivot("target", targets).agg(F.first(value))


def strongest(correlation: DataFrame, value: str) -> DataFrame:
    return correlation.orderBy(F.abs(value).desc_nulls_last(), "feature", "target").limit(1)


def latest_known(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value that isn't null of each key."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def means_with_interval(rows: DataFrame, target: str) -> DataFrame:
    """Mean of each quantile and half of its 95 % interval."""
    t = F.col(target)
    return rows.groupBy("quantile").agg(F.count("*").alias("n"), F.avg(t).alias("mean"), (F.stddev_samp(t) / F.sqrt(F.count("*")) * 1.96).alias("half_width"))


def timeline(df: DataFrame, ticker: str, newest_first: bool = False) -> DataFrame:
    return df.where(F.col("ticker") == ticker).orderBy(F.col("date").desc() if newest_first else F.col("date"))


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows that every run picks alike."""
    return df.orderBy(F.xxhash64(key), key).limit(n)
