"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The shared folder, set as Spark's checkpoint folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as files in the shared folder spark.checkpoint.dir.

    The files outlive executors, unlike cached blocks. Where the session has no such setting
    (a local test) a temporary folder serves, which is right only on one machine.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Deletes the files of a table that `cut` or `stored` returned, once nothing reads it any more; other tables stay as they are."""
    if "_stored" in vars(df):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
        return
    plan = df._jdf.queryExecution().logical()
    if plan.getClass().getSimpleName() != "LogicalRDD" or plan.rdd().getCheckpointFile().isEmpty():
        return
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as Parquet in the shared folder spark.checkpoint.dir: smaller than checkpoint files, and read by column.

    `release` deletes it.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stored = path
    return kept
