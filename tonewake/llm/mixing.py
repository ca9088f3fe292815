"""Mixing sources to target sizes by systematic sampling, in DataFrame functions.

Within a source every document expects target / source size copies.  Documents stand in order of size; the prefix sum of
expected copies, moved by one keyed offset a source, emits a copy at each integer that it crosses.  As neighbours in that
order have nearly equal sizes, the words taken stay near the target whatever the sizes' spread.

The order is by (source, size class, salt, size, keyed hash): ranks come from counts of (source, class, salt), a table with
a row for about ROWS_PER_CELL documents, and a row number within each; so no source is one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import cut

WEIGHTS = (5, 2, 1)
CAP = 3
ROWS_PER_CELL = 4_000
#: Files of tables with a row for each source or cell.
SMALL = 16
SPACES = " \t\n\x0b\x0c\r"
#: A word with the spaces after it.
WORD = r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def n_words(text):
    """Each word of the trimmed text becomes one character: regexp_count would hold all words of a text, a string each."""
    return F.coalesce(F.length(F.regexp_replace(F.btrim(text, F.lit(SPACES)), WORD, "x")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: source, source_size.  Adds target: the sources' weights, dealt out by code point with null last, share the
    total; a target stops at cap times its source's size and the excess is shared anew until none is above.

    Where all sizes are 0, so are the targets."""
    ranked = sizes.withColumn("__r", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__r") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("__w", weight).drop("__r"), "targets", SMALL)
    most, level, capped = cap * F.col("source_size"), 0.0, -1
    while True:
        at = most <= F.lit(level) * F.col("__w")
        r = ranked.agg(F.sum("source_size").alias("total"), F.sum(F.when(at, 1).otherwise(0)).alias("n"), F.sum(F.when(at, most)).alias("full"), F.sum(F.when(~at, F.col("__w"))).alias("w")).first()
        if not r["total"] or r["n"] == capped or not r["w"]:
            break
        capped, level = r["n"], (r["total"] - (r["full"] or 0)) / r["w"]
    return ranked.withColumn("target", F.least(most.cast("double"), F.lit(level) * F.col("__w"))).drop("__w")


def mix(docs: DataFrame, seed: int = 29, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, columns: list[str] | None = None) -> DataFrame:
    """docs (doc_id, source, text and others) with size (words; a null text has 0), source_size, target and copies.

    columns: those of docs to give, all if None.  Without the text among them, texts are read once, for the sizes; else twice.

    Inputs named like an output are replaced.  A document of size 0 may get copies, which take no words.  Repeated rows are
    documents of their own.  Rows are told apart by a hash of id and text, so rows of one id, or without one, are dealt and
    ordered by their texts; equal rows can't be told apart and share what copies they get.  Reruns agree, whatever the partitions."""
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ("size", "source_size", "target", "copies")]
    sized = docs.select(*dict.fromkeys([*columns, "doc_id", "source", "text"])).withColumn("size", n_words(F.col("text").cast("string")))
    mark = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    placed = sized.withColumn("__class", F.floor(8 * F.log2(F.col("size") + 1)).cast("int")).withColumn("__mark", mark)
    if "text" in columns:
        light = cut(placed.select("source", "__class", "__mark", "size"), "sizes")
    else:
        light = placed = cut(placed.drop("text"), "sizes")
    cells = light.groupBy("source", "__class").agg(F.count("*").alias("__n"), F.sum("size").alias("__words"))
    cells = cut(cells.withColumn("__salts", F.ceil(F.col("__n") / ROWS_PER_CELL).cast("int")), "cells", SMALL)
    by_source = targets(cells.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, cap)
    salts = cells.select(F.col("source").alias("__s"), F.col("__class").alias("__c"), "__salts")
    same_cell = F.col("source").eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c"))
    salt = F.pmod(F.col("__mark"), F.col("__salts")).cast("int")
    counted = light.join(salts, same_cell).withColumn("__salt", salt).groupBy("source", "__class", "__salt").agg(F.count("*").alias("__n"))
    before = counted.withColumn("__before", F.sum("__n").over(Window.partitionBy("source").orderBy("__class", "__salt")) - F.col("__n"))
    sources = by_source.select(F.col("source").alias("__s2"), "source_size", "target")
    cell_table = before.join(sources, F.col("source").eqNullSafe(F.col("__s2"))).select(F.col("source").alias("__s3"), F.col("__class").alias("__c3"), F.col("__salt").alias("__t3"), "__before", "source_size", "target")
    cell_table = cut(cell_table, "mix-cells", SMALL)
    salted = placed.join(salts, same_cell).withColumn("__salt", salt)
    rank = F.row_number().over(Window.partitionBy("source", "__class", "__salt").orderBy("size", "__mark", "doc_id")) - 1
    ranked = salted.withColumn("__rank", rank).join(cell_table, F.col("source").eqNullSafe(F.col("__s3")) & (F.col("__class") == F.col("__c3")) & (F.col("__salt") == F.col("__t3")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.coalesce(F.col("source").cast("string"), F.lit("\x00"))), F.lit(1 << 20)) / float(1 << 20)
    place = F.col("__before") + F.col("__rank")
    copies = F.least(F.lit(cap), F.floor(offset + rate * (place + 1)) - F.floor(offset + rate * place)).cast("int")
    return ranked.select(*columns, "size", "source_size", "target", copies.alias("copies"))


def take(mixed: DataFrame) -> DataFrame:
    """Each document as often as it has copies, without the columns of mix()."""
    columns = [c for c in mixed.columns if c not in ("size", "source_size", "target", "copies")]
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy")).drop("__copy")
