"""Incremental attestation: event files arrive, transitions between a user's event kinds are counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def attested_windows(spark: SparkSession, path: str, *, window: str = "1 day", late: str = "1 hour", schema: str = EVENT) -> DataFrame:
    """A streaming count of events per kind and window; rows later than the watermark are dropped, as declared."""
    events = spark.readStream.schema(schema).parquet(path)
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))


def merge_into(path: str):
    """A ``foreachBatch`` sink that adds each batch's (from_id, to_id, pipeline) edges to those written before."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.select("from_id", "to_id", "pipeline").distinct().write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def merged(spark: SparkSession, path: str) -> DataFrame:
    """(from_id, to_id, attestations) over all batches; a batch that was written twice counts once."""
    return spark.read.parquet(path).groupBy("from_id", "to_id").agg(F.count_distinct("pipeline").alias("attestations"))
