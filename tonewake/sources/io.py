"""Transcripts, scores, prices and companies in and out, with schemas checked at the boundary."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonewake.functions.text import date_string, exchange_name, parsed_date, strip
from tonewake.operators.scoring import PROBABILITIES
from tonewake.sources.scratch import exists

RAW = "date array<string>, exchange string, q string, ticker string, transcript string"
PRICES = "ticker string, day date, close double"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw transcripts by the path's ending: Parquet, JSON lines or CSV.  A date that is one string becomes an array of it.

    Pickles are not read: unpickling runs code.  Convert them once, where they are trusted."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending == "parquet":
        df = spark.read.parquet(path)
    elif ending == "json":
        df = spark.read.json(path)
    elif ending == "csv":
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown kind of file: {path}")
    if not dict(df.dtypes)["date"].startswith("array"):
        df = df.withColumn("date", F.when(F.col("date").isNotNull(), F.array(F.col("date").cast("string"))))
    return df.select("date", "exchange", "q", "ticker", "transcript")


def standardise(raw: DataFrame) -> DataFrame:
    """The transcripts table: ticker, date, fiscal_quarter, exchange, transcript_text, has_qa_section."""
    return raw.select(
        F.upper(strip(F.col("ticker"))).alias("ticker"),
        parsed_date(date_string(F.col("date"))).alias("date"),
        strip(F.col("q")).alias("fiscal_quarter"),
        exchange_name(F.col("exchange")).alias("exchange"),
        F.col("transcript").alias("transcript_text"),
        F.coalesce(F.col("transcript").contains("Questions and Answers:"), F.lit(False)).alias("has_qa_section"),
    )


def load_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return standardise(read_raw(spark, path))


def missing_to_null(df: DataFrame) -> DataFrame:
    """Doubles that are no number become null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def read_scores(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Scored chunks, pruned to columns where given; the probabilities have to be there."""
    df = spark.read.parquet(path)
    lacking = sorted(set(PROBABILITIES) - set(df.columns))
    if lacking:
        raise ValueError(f"no columns {', '.join(lacking)} in {path}")
    return missing_to_null(df.select(*columns) if columns else df)


def write_scores(df: DataFrame, path: str, model: str, overlap: bool, batch_size: int = 32) -> None:
    """Scores as Parquet, and one JSON line of where they come from beside them; a batch's seconds are those of the write."""
    began = time.perf_counter()
    df.write.mode("overwrite").parquet(path)
    seconds = time.perf_counter() - began
    spark = df.sparkSession
    each = F.round(F.lit(seconds) / F.greatest(F.lit(1), F.ceil(F.col("chunk_count") / batch_size)), 4)
    about = spark.read.parquet(path).agg(F.count("*").alias("chunk_count")).select(F.lit(model).alias("model"), F.current_timestamp().cast("string").alias("inference_date"), "chunk_count", F.lit(overlap).alias("overlap"), F.lit(batch_size).alias("batch_size"), each.alias("avg_batch_time_s"))
    about.write.mode("overwrite").json(path.rstrip("/") + ".meta.json")


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """A long price table, one row for each (ticker, day)."""
    df = spark.read.parquet(path).select("ticker", F.col("day").cast("date").alias("day"), F.col("close").cast("double").alias("close"))
    return missing_to_null(df).groupBy("ticker", "day").agg(F.min("close").alias("close"))


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    return missing_to_null(spark.read.parquet(path).select("ticker", F.col("market_cap").cast("double").alias("market_cap"), "sector"))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


# --- resumable batches


def write_batch(df: DataFrame, path: str, start: int, end: int) -> None:
    """The scores of transcripts start to end - 1; running it again replaces them."""
    df.withColumn("start", F.lit(start)).withColumn("end", F.lit(end)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("start", "end").parquet(path)


def numbered(df: DataFrame, keys: list[str], per_part: int = 100_000) -> DataFrame:
    """df with position, 0 to n - 1, by hash of the keys and then the keys: the same for any partitions, and no one task sorts all.

    The keys have to tell rows apart; rows that share them are numbered in any order."""
    n = df.count()
    parts = max(1, -(-n // per_part))
    marked = df.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each part
    ranked = marked.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1)
    return ranked.join(F.broadcast(before), "__part").withColumn("position", F.col("__before") + F.col("__rank")).drop("__part", "__before", "__rank")


def score_batches(transcripts: DataFrame, path: str, score, size: int = 1750, force: bool = False) -> DataFrame:
    """score(transcripts) for all batches of size transcripts that path doesn't hold yet (for all, if force); returns progress().

    Positions come from ticker, date and text, so a run that goes on after a stop numbers as the first did.  A batch is a
    folder, and replaces what is left of one that a lost run began."""
    spark = transcripts.sparkSession
    placed = numbered(transcripts, ["ticker", "date", "transcript_text"]).withColumn("start", F.floor(F.col("position") / size) * size)
    total = placed.count()
    placed = placed.withColumn("end", F.least(F.col("start") + size, F.lit(total).cast("long")))
    there = batches(spark.read.parquet(path)) if exists(spark, path) else spark.createDataFrame([], "start long, end long")
    todo = placed if force else placed.join(F.broadcast(there), ["start", "end"], "left_anti")  # a row for each batch
    for start, end in sorted((r["start"], r["end"]) for r in todo.select("start", "end").distinct().collect()):
        write_batch(score(todo.where(F.col("start") == start).drop("position", "start", "end")), path, start, end)
    return progress(batches(spark.read.parquet(path)), total) if total else progress(there, 0)


def batches(df: DataFrame) -> DataFrame:
    """start, end of the batches that are there."""
    return df.select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()


def batch_gaps(done: DataFrame) -> DataFrame:
    """Batches that do not begin where the one before ends, the first at 0; none if a merge is whole."""
    expected = F.coalesce(F.lag("end").over(Window.orderBy("start")), F.lit(0))  # a row for each batch
    return done.withColumn("expected", expected).where("start <> expected")


def merge_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches as one table; a gap raises."""
    df = spark.read.parquet(path)
    gaps = batch_gaps(batches(df)).collect()
    if gaps:
        raise ValueError(f"batches are missing before {[r['start'] for r in gaps]}")
    return df.drop("start", "end")


def progress(done: DataFrame, total: int, seconds_each: float = 6.1) -> DataFrame:
    """One row: transcripts done and left, and the estimated seconds."""
    n = F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))
    return done.agg(n.alias("done")).select("done", (F.lit(total) - F.col("done")).alias("remaining"), ((F.lit(total) - F.col("done")) * seconds_each).alias("eta_seconds"))
