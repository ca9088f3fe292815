"""Where operators put what they write between jobs, and how rows of whole texts are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewake.sources.scratch import cut, drop, exists, new_path, shared_dir

__all__ = ["cut", "drop", "exists", "for_long_rows", "new_path", "pieces_of", "shared_dir", "text_bytes"]

#: Rows of whole texts that are held at a time; Spark's own numbers are for short rows, and cost tens of MB a task here.
LONG_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}


def for_long_rows(spark: SparkSession) -> SparkSession:
    """The session with smaller batches, where it has Spark's defaults."""
    for name, (default, ours) in LONG_ROWS.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)
    return spark


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: what the numbers of ranges follow, so that a range's share stays the same at every size."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def pieces_of(total: int, each: int, least: int) -> int:
    return max(least, -(-total // each))
