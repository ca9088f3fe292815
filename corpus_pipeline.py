"""A training corpus from documents: quality rules, near duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet into the shared folder and reads
back as the next one's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewake.llm import decontaminate, mixing, ordering, quality, simjoin
from tonewake.llm.queries import TOKENIZER
from tonewake.llm.state import cut, for_long_rows, new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their failing lines gone."""
    for_long_rows(spark)
    judged = quality.quality(docs, [c for c in docs.columns if c not in ("text", "n_chars")], cleaned=True).where("kept")
    return judged.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("clean_text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that of least doc_id (without an id last), then of least hash of its text.

    Rows are told apart by id and a 64-bit hash of the text, so of rows that share an id only the chosen one stays, and equal
    rows are one.  Documents without words link with nothing: all their rows stay."""
    for_long_rows(spark)
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    linked = simjoin.link(marked, mark="__mark").where("root is not null")
    chosen = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__mark")).alias("c")).select(F.col("c.doc_id").alias("__id"), F.col("c.__mark").alias("__own"))
    same = marked["doc_id"].eqNullSafe(F.col("__id")) & (marked["__mark"] == F.col("__own"))
    kept = marked.where(worded).join(chosen, same, "left_semi").dropDuplicates(["doc_id", "__mark"])
    return kept.unionByName(marked.where(~worded)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    for_long_rows(spark)
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs.columns)
    return found.where(F.size("hit_items") == 0).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    for_long_rows(spark)
    return mixing.take(mixing.mix(docs)).select(*docs.columns)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of the written shards."""
    for_long_rows(spark)
    return ordering.write_training_order(docs, TOKENIZER, new_path(spark, "training-order", keep=True))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mix", source_mix),
    ("training order", training_order),
]

#: Token ids and shards are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
