"""Two-pass external shuffle into shards, in DataFrame functions only.

Pass one scatters whole rows by a seeded hash into buckets that fit in memory; pass two shuffles each bucket (Spark's shuffle()
is the Fisher-Yates shuffle), deals the shuffled rows out and writes them.  The law is `rows`: shards' counts are at most one
apart, whatever the keys hold, so one key or group of copies with a third of all rows weighs on no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .state import cut

BUCKET_BYTES = 8 << 20
#: Buckets a task takes: each task writes one file into each shard.
BUCKETS_PER_TASK = 4


def width(rows: DataFrame) -> Column:
    """Bytes of a row in memory: its strings and binaries, 8 for each simple column, nested ones by their JSON."""
    nested = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    long = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) for c in long] + [F.octet_length(F.to_json(F.struct(c))) for c in nested]
    return sum(sizes, F.lit(8 * len(rows.columns) + 8)).cast("long")


def shard(rows: DataFrame, shards: int, key: list[str], seed: int = 17, bucket_bytes: int = BUCKET_BYTES, row_bytes: int | None = None) -> DataFrame:
    """rows with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in its shard); inputs of those names are replaced.

    key: columns that tell rows apart; it seeds the scatter.  Rows that share a key are spread by their place in the input
    once they would overfill a bucket, so equal rows may hold any share.  Nulls hash like a value.  An empty table gives an
    empty one.  row_bytes: size of a row in memory, measured where None.  Partitions follow each other in slot order.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(*columns)
    mark = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])
    n, size = rows.agg(F.count("*"), F.sum(F.lit(row_bytes) if row_bytes else width(rows))).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    tasks = -(-buckets // BUCKETS_PER_TASK)
    fits = max(1, n // buckets)
    marked = rows.withColumn("__mark", mark)
    heavy = [r[0] for r in marked.groupBy("__mark").count().where(F.col("count") > fits).select("__mark").collect()]  # as many as buckets at most
    if heavy:  # stored, as both jobs below must see the same places
        place = F.when(F.col("__mark").isin(heavy), F.xxhash64("__mark", F.monotonically_increasing_id())).otherwise(F.col("__mark"))
        marked = cut(marked.withColumn("__place", place), "places")
    else:
        marked = marked.withColumn("__place", F.col("__mark"))
    scattered = marked.withColumn("__bucket", F.pmod(F.xxhash64("__place"), F.lit(buckets)).cast("int")).withColumn("__task", F.pmod("__bucket", F.lit(tasks)))
    sizes = cut(scattered.groupBy("__task", "__bucket").agg(F.count("*").alias("__n")), "buckets", 16)  # a row for each bucket
    before = sizes.selectExpr("__bucket", "cast(sum(__n) over (order by __task, __bucket) - __n as bigint) as __before")
    whole = F.struct("__mark", *columns)
    grouped = scattered.repartitionById(tasks, F.col("__task")).groupBy("__task", "__bucket").agg(F.sort_array(F.collect_list(whole)).alias("__rows"))
    dealt = grouped.sortWithinPartitions("__task", "__bucket").select("__bucket", F.posexplode(F.shuffle("__rows", seed)).alias("__at", "__row"))
    order = F.col("__before") + F.col("__at")
    return dealt.join(F.broadcast(before), "__bucket").select(*[F.col(f"__row.{c}").alias(c) for c in columns], F.pmod(order, F.lit(shards)).cast("int").alias("shard"), F.floor(order / shards).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard; its files by name, and the rows in each, are in slot order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, sharded: DataFrame) -> DataFrame:
    """The rows that write_shards stored."""
    return spark.read.schema(sharded.schema).parquet(path)
