"""Checks and summaries of loaded transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT_CHARS = 500


def load_summary(df: DataFrame) -> DataFrame:
    """One row: rows, first and last date, tickers, mean length, rows and share with a Q&A section."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.countDistinct("ticker").alias("n_tickers"),
        F.avg(F.length("transcript_text")).alias("mean_length"),
        F.sum(F.col("has_qa_section").cast("long")).alias("n_qa"),
        F.avg(F.col("has_qa_section").cast("double")).alias("share_qa"),
    )


def validate(df: DataFrame, short: int = SHORT_CHARS) -> DataFrame:
    """One row of counts: empty texts, null dates, rows in duplicated (ticker, date), such groups with a date, short texts."""
    per = df.groupBy("ticker", "date").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.coalesce(F.trim("transcript_text"), F.lit("")) == "", 1).otherwise(0)).alias("empty"),
        F.sum(F.when(F.length("transcript_text") < short, 1).otherwise(0)).alias("short"),
    )
    return per.agg(
        F.sum("n").alias("total_rows"),
        F.sum("empty").alias("empty_texts"),
        F.sum(F.when(F.col("date").isNull(), F.col("n")).otherwise(0)).alias("null_dates"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_rows"),
        F.sum(F.when((F.col("n") > 1) & F.col("date").isNotNull() & F.col("ticker").isNotNull(), 1).otherwise(0)).alias("duplicate_groups"),
        F.sum("short").alias("short_texts"),
    )
