"""Exact order statistics and average ranks, without all values of a group in one task.

A sketch gives each group CUTS cut points, which only balance the work: values between two cuts are a part, parts are counted,
and what has to be sorted is sorted part by part.  Equal values are summed before any sort, so one value may hold any share of
the rows.  Groups are told by columns without nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cut points of a group; a part is found by a binary search of so many bits.
BITS = 10
CUTS = (1 << BITS) - 1
#: A constant group where none is asked for.
ALL = "__all"


def _cuts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    fractions = F.array(*[F.lit(i / (CUTS + 1)) for i in range(1, CUTS + 1)])
    return rows.groupBy(*keys).agg(F.count("*").alias("__rows"), F.percentile_approx(value, fractions, F.lit(2 * CUTS)).alias("__cuts"))


def _parted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with __rows (of the group) and __part, the number of cuts below the value.

    Each step of the search is a projection of its own, so that generated code does it once a row."""
    out = rows.join(_cuts(rows, keys, value), keys).withColumn("__part", F.lit(0))
    for bit in reversed(range(BITS)):
        step = 1 << bit
        out = out.withColumn("__part", F.col("__part") + F.when(F.get("__cuts", F.col("__part") + step - 1) < F.col(value), step).otherwise(0))
    return out.drop("__cuts")


def quantiles(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by columns with n and edges: the values at the fractions, with linear interpolation between neighbours.

    Nulls in value or by are left out; a group without values has no row, an empty table without by none at all.

    Three passes over (by, value): cuts, counts of parts, and the values of the few parts that hold a needed rank."""
    keys = list(by) or [ALL]
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).dropna()
    rows = rows if by else rows.withColumn(ALL, F.lit(0))
    parted = _parted(rows, keys, "__v")
    places = F.array(*[(F.col("__rows") - 1) * F.lit(float(f)) for f in fractions])
    parts = parted.groupBy(*keys, "__part", "__rows").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    wanted = F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(F.floor(p), F.ceil(p)))))
    inside = F.filter(wanted, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))
    needed = parts.withColumn("__before", before).withColumn("__ranks", inside).where(F.size("__ranks") > 0).select(*keys, "__part", "__before", "__ranks")
    counts = parted.join(needed, [*keys, "__part"]).groupBy(*keys, "__part", "__rows", "__before", "__ranks", "__v").agg(F.count("*").alias("__n"))
    up_to = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v"))
    hits = counts.withColumn("__to", up_to).withColumn("__hit", F.filter("__ranks", lambda r: (r < F.col("__to")) & (r >= F.col("__to") - F.col("__n"))))
    found = hits.select(*keys, "__rows", "__v", F.explode("__hit").alias("__rank")).groupBy(*keys, "__rows").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))

    def edge(p: Column) -> Column:
        low, high = F.element_at("__at", F.floor(p)), F.element_at("__at", F.ceil(p))
        return low + (high - low) * (p - F.floor(p))

    return found.select(*by, F.col("__rows").alias("n"), F.transform(places, edge).alias("edges"))


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with name: the average rank of value (never null) in its by group, from 1.

    Ranks belong to distinct values and return to the rows by a join on the value; where one value holds much, AQE splits it."""
    keys = list(by)
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    parted = _parted(counts, keys, value).drop("__rows")
    parts = parted.groupBy(*keys, "__part").agg(F.sum("__n").alias("__in"))
    before = F.sum("__in").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__in")
    up_to = F.col("__before") + F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy(value))
    ranked = parted.join(parts.select(*keys, "__part", before.alias("__before")), [*keys, "__part"]).select(*keys, value, (up_to - (F.col("__n") - 1) / 2).cast("double").alias(name))
    return rows.join(ranked, [*keys, value])
