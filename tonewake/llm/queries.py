"""The registered queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm, langid, linededup, mixing, ordering, quality, sharding, simjoin, surrogates
from .oracles import ORACLES
from .state import for_long_rows, new_path

#: A public tokenizer's file; nothing of it is copied here.
TOKENIZER = os.environ.get("TONEWAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: In production a secret of the site; surrogates of one key can't be told from another's.
SURROGATE_KEY = os.environ.get("TONEWAKE_SURROGATE_KEY", "tonewake-demo-key")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return for_long_rows(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def id_remainder(modulus: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(texts(spark, sf_dir), table(spark, sf_dir, "benchmark"), ["doc_id"]))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(texts(spark, sf_dir), ["doc_id"])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "pages"), ["page_id"], ratio=0.1, min_pages=10)
    return found.select("page_id", "host", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.md5(F.array_join("kept_lines", "\n")).alias("kept_md5"))


def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(texts(spark, sf_dir))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.write_training_order(texts(spark, sf_dir), TOKENIZER, new_path(spark, "training-order", keep=True))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simjoin.link(texts(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id", "n_copies")


def op7_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_jaccard_join's rows with the number of links, which its SQL doesn't give."""
    return simjoin.link(texts(spark, sf_dir), count_links=True).select("doc_id", "n_shingles", "component_id", "class_id", "n_copies", "n_links")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(id_remainder(4) != 2))
    rows = docs.select("doc_id", "text", (id_remainder(4) == 2).alias("held_out"))
    return langid.predict(rows, model, ["doc_id", "held_out"])


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt, path = sharding.shard(texts(spark, sf_dir), 40, ["doc_id", "text"]), new_path(spark, "shards", keep=True)
    sharding.write_shards(dealt, path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.read_shards(spark, path, dealt).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    if faults := surrogates.collisions(surrogates.anonymise(docs, SURROGATE_KEY, [], with_entities=True).select("entities")).count():
        raise ValueError(f"{faults} entities share a surrogate or have two")
    return surrogates.anonymise(docs, SURROGATE_KEY, ["doc_id"])


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_mixing, op3_quality, op4_line_dedup, op5_hmm_score, op6_training_order, op7_jaccard_join, op7_link_counts, op8_language_id, op9_sharding, op10_surrogates)}
__all__ = ["ORACLES", "QUERIES"]
