"""Tables between jobs: written as Parquet into the folder that driver and executors share, and removed when they are done with."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the context's checkpoint folder; a temporary folder in local mode alone, where one machine is all there is.

    On a cluster without that setting this raises: a folder of the driver's own would be another one on each executor."""
    sc = spark.sparkContext
    context = sc._jsc.sc()
    set_to = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_to is None and context.getCheckpointDir().isDefined():
        set_to = context.getCheckpointDir().get()
    if set_to is None:
        if not context.isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="tonewake-")
    if not context.getCheckpointDir().isDefined():
        sc.setCheckpointDir(set_to)
    return set_to


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _path(spark, path)
    return system.exists(where)


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path of its own; unless keep, it goes with the application at the latest."""
    if keep:
        return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark).rstrip('/')}/tonewake-{spark.sparkContext.applicationId}"
    system, where = _path(spark, folder)
    if not system.exists(where):
        system.mkdirs(where)
        system.deleteOnExit(where)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """The rows written into the shared folder and read back: later jobs neither redo nor lose them.

    files: the most files to write, and so tasks of the last stage, where the caller knows how much there is."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["scratch_path"] = path
    return out


def drop(*frames: DataFrame) -> None:
    """Removes what cut() wrote for these frames; no plan may read them any more."""
    for df in frames:
        path = df.__dict__.pop("scratch_path", None)
        if path:
            system, where = _path(df.sparkSession, path)
            system.delete(where, True)
