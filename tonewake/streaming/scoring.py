"""Transcripts scored as they arrive: files that are there are taken once, and a restart goes on where it stopped.

Of the transcripts of one (ticker, date) in one batch of files the longest is scored; one that comes in a later batch, when
that call has its scores, is left out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonewake.operators import transcripts as texts
from tonewake.operators.scoring import Scorer, score_chunks
from tonewake.sources.scratch import exists

TRANSCRIPTS = "ticker string, date date, fiscal_quarter string, exchange string, transcript_text string, has_qa_section boolean"


def score_available(spark: SparkSession, source: str, target: str, checkpoint: str, scorer: Scorer | None = None, files_each: int = 100) -> StreamingQuery:
    """A stream over the Parquet files in source, each batch of files chunked, scored and appended once."""
    stream = spark.readStream.schema(TRANSCRIPTS).option("maxFilesPerTrigger", files_each).parquet(source)

    def batch(df, number: int) -> None:
        here = df.sparkSession
        if exists(here, target):
            before = here.read.parquet(target).where(F.col("batch") < number).select(F.col("ticker").alias("__t"), F.col("date").alias("__d")).distinct()
            df = df.join(before, df["ticker"].eqNullSafe(before["__t"]) & df["date"].eqNullSafe(before["__d"]), "left_anti")
        scored = score_chunks(texts.chunk_transcripts(df), scorer)
        scored.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
