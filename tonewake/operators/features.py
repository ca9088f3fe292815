"""Scored chunks to one feature row for each ticker and date, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonewake.functions.text import word_count

FEATURES = ["net_sentiment", "sentiment_delta", "qa_divergence", "ceo_sentiment", "cfo_sentiment", "analyst_tone", "sentiment_variance", "negative_chunk_pct", "chunk_count"]


def transcript_aggregates(scores: DataFrame) -> DataFrame:
    """All levels, section means, role means and linguistic measures by (ticker, date); rows with a null key are left out."""
    net = F.col("positive_prob") - F.col("negative_prob")
    in_section = lambda s: F.avg(F.when(F.col("source_section") == s, net))
    by_role = lambda r: F.avg(F.when(F.col("role") == r, net))
    return (
        scores.where("ticker is not null and date is not null")
        .groupBy("ticker", "date")
        .agg(
            F.avg("positive_prob").alias("mean_positive"),
            F.avg("negative_prob").alias("mean_negative"),
            F.avg("neutral_prob").alias("mean_neutral"),
            F.avg(net).alias("net_sentiment"),
            F.stddev_samp("positive_prob").alias("sentiment_variance"),
            F.max("positive_prob").alias("max_positive"),
            F.min("positive_prob").alias("min_positive"),
            F.count("positive_prob").alias("chunk_count"),
            in_section("prepared_remarks").alias("prepared_net"),
            in_section("qa_session").alias("qa_net"),
            by_role("ceo").alias("ceo_sentiment"),
            by_role("cfo").alias("cfo_sentiment"),
            by_role("analyst").alias("analyst_tone"),
            F.avg((F.col("negative_prob") > 0.5).cast("double")).alias("negative_chunk_pct"),
            *([F.sum(word_count(F.col("chunk_text"))).alias("word_count")] if "chunk_text" in scores.columns else []),
        )
        .withColumn("qa_divergence", F.col("qa_net") - F.col("prepared_net"))
    )


def with_delta(df: DataFrame, value: str = "net_sentiment", name: str = "sentiment_delta") -> DataFrame:
    """Change from the ticker's last observed row."""
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy("ticker").orderBy("date")))


def feature_matrix(scores: DataFrame) -> DataFrame:
    return with_delta(transcript_aggregates(scores)).select("ticker", "date", *FEATURES)


def analysis_ready(features: DataFrame, timing: DataFrame, returns, company: DataFrame) -> DataFrame:
    """features with after_close (unknown is True), the returns that returns(df) adds, and the company's snapshot."""
    known = timing.select("ticker", F.col("call_date").alias("date"), "after_close")
    timed = features.join(known, ["ticker", "date"], "left").withColumn("after_close", F.coalesce("after_close", F.lit(True)))
    return returns(timed).join(company, "ticker", "left").drop("after_close").withColumn("log_market_cap", F.when(F.col("market_cap") > 0, F.ln("market_cap")))
