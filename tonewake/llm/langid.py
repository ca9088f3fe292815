"""Language identification by error-correcting output codes.

Every language has a codeword of bits; one binary classifier for each bit reads hashed byte trigrams; the answer is the
language whose codeword has the least loss, each bit's logistic loss weighted by what that bit got right in training.  Two
languages at nearly the same loss flag the text as ambiguous.

Training takes at most per_language labelled documents of each language, and TOTAL in all (one of each language at least):
those of least keyed hash of id and text, copies once.  They are turned to count vectors on the executors, so the driver gets
TOTAL * DIMS numbers at most while there are no more languages than that.  The sample doesn't hang on partitions.
Prediction reads every whole text.  A null text, or one without a letter, is `und` with score 0; so is every text where
nothing was labelled.  Texts of up to two letters are read like others.  Each row is read alone.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewake.sources.shipping import ship

from .kernels import flat

DIMS = 4096
PER_LANGUAGE = 300
TOTAL = 6000
RIDGE = 0.05
SHARPNESS = 6.0
AMBIGUOUS = 0.1
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")

#: Letters of A-Z become lower case; all else below 128 that is no letter is one space.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint32)


def features(data: np.ndarray) -> np.ndarray:
    """Root counts of hashed byte trigrams, of unit length."""
    folded = FOLD[data]
    if len(folded) < 3:
        folded = np.concatenate([folded, np.full(3 - len(folded), 32, np.uint32)])
    code = (folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]
    slots = (code * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.sqrt(np.bincount(slots, minlength=DIMS).astype(np.float32))
    return counts / np.linalg.norm(counts)


def codebook(n: int) -> np.ndarray:
    """n codewords of -1 and 1: all splits of the languages where they are few, else seeded random bits, kept far apart."""
    if n <= 7:
        rows = [[1, *bits] for bits in itertools.product((1, -1), repeat=n - 1) if -1 in bits]
        return np.array(rows, np.float32).T.reshape(n, -1)
    bits, best, far = max(15, int(10 * np.log2(n))), None, -1
    rng = np.random.default_rng(7)
    for _ in range(50):
        book = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        if np.any(np.abs(book.sum(0)) == n):
            continue
        apart = ((bits - book @ book.T) / 2 + bits * np.eye(n)).min()
        if apart > far:
            best, far = book, apart
    return best


def fit(x: np.ndarray, labels: list[str]) -> dict:
    """Ridge classifiers for the bits, by the dual form; weights are each bit's share of right answers above chance."""
    languages = sorted(set(labels))
    model = {"languages": languages, "weights": np.zeros((DIMS, 0), np.float32), "bias": np.zeros(0, np.float32), "book": np.zeros((len(languages), 0), np.float32), "trust": np.zeros(0, np.float32)}
    if len(languages) < 2:
        return model
    book = codebook(len(languages))
    y = book[[languages.index(v) for v in labels]]
    mean = x.mean(0)
    centred, bias = x - mean, y.mean(0)
    gram = centred @ centred.T
    dual = np.linalg.solve(gram + RIDGE * np.eye(len(x), dtype=np.float32), y - bias)
    weights = (centred.T @ dual).astype(np.float32)
    bias = (bias - mean @ weights).astype(np.float32)
    right = (np.sign(x @ weights + bias) == y).mean(0)
    trust = np.maximum(right - 0.5, 0.01)
    return model | {"weights": weights, "bias": bias, "book": book, "trust": (trust / trust.sum()).astype(np.float32)}


def decode(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of bit margins: the language's number, its probability, and whether the second is close."""
    loss = np.log1p(np.exp(-margins[:, None, :] * model["book"][None] * 2)) @ model["trust"]
    p = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    second = np.sort(p, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
    top = p[np.arange(len(p)), best]
    return best, top, top - second < AMBIGUOUS


def _as_vectors(batches):
    for batch in batches:
        data, offsets = flat(batch.column(1))
        vectors = [features(data[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["lang", "vector"])


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> DataFrame:
    """lang, text of the training documents; rows with a null text or lang are left out."""
    mark = F.xxhash64(F.lit("langid"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), mark.alias("h")).where("text is not null and lang is not null")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    each = F.greatest(F.lit(1), F.least(F.lit(per_language), F.floor(F.lit(total) / F.col("languages"))))
    sizes = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("languages")))).select("lang", each.cast("int").alias("each"), "n")  # one row
    # twice as many as wanted pass the first sieve, so that few rows are sorted; a language of few different texts passes whole
    below = F.when(F.col("n") <= 4 * F.col("each"), 1.0).otherwise(2.0 * F.col("each") / F.col("n"))
    sieved = rows.join(F.broadcast(sizes.select("lang", "each", below.alias("share"))), "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("share") * float(1 << 40))  # a row for each language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))
    return sieved.dropDuplicates(["lang", "h"]).withColumn("r", rank).where("r <= each").select("lang", "text")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The model of sample(labelled); labelled: doc_id, text, lang."""
    ship(labelled.sparkSession)
    got = sorted((r["lang"], bytes(r["vector"])) for r in sample(labelled, per_language).mapInArrow(_as_vectors, "lang string, vector binary").collect())
    x = np.frombuffer(b"".join(v for _, v in got), np.float32).reshape(-1, DIMS)
    return fit(x, [lang for lang, _ in got])


def predict(docs: DataFrame, model: dict, carry: list[str]) -> DataFrame:
    """Columns carry of docs with lang_pred, score (0 to 1) and ambiguous; inputs named like an output are replaced."""
    ship(docs.sparkSession)
    outputs = ("lang_pred", "score", "ambiguous")
    kept = [f for f in docs.schema.fields if f.name in carry and f.name not in outputs]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            data, offsets = flat(column)
            texts = np.array([bool(LETTER.search(x)) if (x := t.as_py()) else False for t in column], bool)
            names, scores, close = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            rows = np.flatnonzero(texts)
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                if len(m["languages"]) == 1:
                    best, top, near = np.zeros(len(some), int), np.ones(len(some)), np.zeros(len(some), bool)
                elif m["languages"]:
                    x = np.stack([features(data[offsets[i] : offsets[i + 1]]) for i in some])
                    best, top, near = decode(m, x @ m["weights"] + m["bias"])
                else:
                    continue
                scores[some], close[some] = top, near
                for i, b in zip(some, best, strict=True):
                    names[i] = m["languages"][b]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], names=schema.names)

    return docs.select(*[F.col(f.name) for f in kept], F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)
