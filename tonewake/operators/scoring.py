"""Scores of chunks: positive, negative and neutral probabilities that sum to 1, by a scorer that is given.

The lexicon scorer is plain SQL and stands in where no model is at hand; a model runs in an iterator-style Arrow UDF that loads
it once a worker.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewake.functions.patterns import MAX_TOKENS

PROBABILITIES = ["positive_prob", "negative_prob", "neutral_prob"]
POSITIVE = ("beat", "gain", "good", "great", "growth", "improve", "improved", "pleased", "profit", "record", "strong", "success")
NEGATIVE = ("bad", "challenge", "decline", "difficult", "fall", "loss", "miss", "pressure", "risk", "slow", "weak", "worse")


class Scorer(Protocol):
    def __call__(self, texts: DataFrame, text: str) -> DataFrame: ...


def lexicon_probabilities(text: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> dict[str, Column]:
    words = lambda ws: F.regexp_count(F.lower(text), F.lit(r"\b(?:" + "|".join(ws) + r")\b"))
    p, n = F.coalesce(words(positive), F.lit(0)), F.coalesce(words(negative), F.lit(0))
    total = p + n + 1
    return {"positive_prob": p / total, "negative_prob": n / total, "neutral_prob": 1 / total}


def lexicon(positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Scorer:
    return lambda df, text: df.withColumns(lexicon_probabilities(F.col(text), positive, negative))


def model(load: Callable[[], Callable[[pd.Series], pd.DataFrame]]) -> Scorer:
    """load() gives, once a worker, a function from texts to a frame of the three probabilities."""

    @F.pandas_udf("positive_prob double, negative_prob double, neutral_prob double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = load()
        for texts in batches:
            yield score(texts)[PROBABILITIES]

    return lambda df, text: df.withColumn("__s", scored(F.col(text))).select(*df.columns, *[F.col(f"__s.{c}").alias(c) for c in PROBABILITIES])


def seconds_per_chunk(chunks: DataFrame, scorer: Scorer | None = None, warm_up: int = 2, text: str = "chunk_text") -> float:
    """Wall-clock seconds a chunk, after some runs that aren't timed; chunks should be few and stored."""
    scored = score_chunks(chunks, scorer, text)
    for _ in range(warm_up):
        scored.write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    scored.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) / max(1, chunks.count())


def labelled(rows: DataFrame, labels: dict[int, str], values: str = "values") -> DataFrame:
    """An array of probabilities spread into the three columns, by the model's own order of labels (a number to a name)."""
    at = {name.lower(): k for k, name in labels.items()}
    return rows.select("*", *[F.get(values, F.lit(at[c.removesuffix("_prob")])).alias(c) for c in PROBABILITIES]).drop(values)


def over_limit(chunks: DataFrame, limit: int = MAX_TOKENS) -> DataFrame:
    """One row: chunks whose estimate is above the model's limit, so that it will cut them, and all chunks."""
    return chunks.agg(F.coalesce(F.sum((F.col("chunk_token_count") > limit).cast("long")), F.lit(0)).alias("n_over"), F.count("*").alias("n_chunks"))


def score_chunks(chunks: DataFrame, scorer: Scorer | None = None, text: str = "chunk_text") -> DataFrame:
    return (scorer or lexicon())(chunks, text)
