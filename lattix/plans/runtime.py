"""Cutting lineage and keeping intermediate tables, through the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and all of Spark
    runs on this machine (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="lattix-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on a key of few values, each with many rows on both sides: the rows of ``left`` are dealt over eight ways a
    core and the smaller ``right`` goes to every way, so no key's product falls to one task.  What follows without a shuffle,
    projections and writing, is spread alike."""
    n = 8 * left.sparkSession.sparkContext.defaultParallelism
    dealt = left.withColumn("__way", F.pmod(F.xxhash64(*left.columns), F.lit(n)).cast("int")).repartition(n, key, "__way")
    every = right.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, key, "__way")
    return dealt.join(every, [key, "__way"]).drop("__way")


def cut(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: its lineage ends there, it is made once, and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
