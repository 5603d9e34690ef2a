"""Triage of causal hypotheses: what a design lets one claim, and what the graph knows of the proposed estimator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators.traverse import neighbourhood

# Designs and what they let one claim.
CLAIMS = {"descriptive": "DESCRIPTIVE", "interventional": "IDENTIFIED"}
OTHERWISE = "NOT IDENTIFIABLE"


def evaluability(design: Column) -> Column:
    out = F.lit(OTHERWISE)
    for d, claim in CLAIMS.items():
        out = F.when(design == d, claim).otherwise(out)
    return out


def ground(hypotheses: DataFrame, entity: DataFrame, rel: DataFrame) -> DataFrame:
    """(hypothesis, design, method_id) to those and claim, found, operations, statistics and assumptions: names of the
    estimator's neighbours, or ``found`` false where the graph has no such method, a gap in its coverage."""
    near = neighbourhood(entity, rel).where(F.col("bucket").isin("operations", "statistics", "assumptions"))
    near = near.join(hypotheses.select("method_id").distinct(), "method_id", "left_semi")
    named = lambda b: F.array_sort(F.collect_set(F.when(F.col("bucket") == b, F.col("name")))).alias(b)
    per = near.groupBy("method_id").agg(*map(named, ("operations", "statistics", "assumptions")))
    known = entity.where("kind = 'Method'").select(F.col("id").alias("method_id"), F.lit(True).alias("found"))
    x = hypotheses.select("hypothesis", "design", "method_id").join(known, "method_id", "left").join(per, "method_id", "left")
    none = F.array().cast("array<string>")
    listed = [F.coalesce(c, none).alias(c) for c in ("operations", "statistics", "assumptions")]
    return x.select("hypothesis", "design", "method_id", evaluability(F.coalesce("design", F.lit(""))).alias("claim"), F.coalesce("found", F.lit(False)).alias("found"), *listed)


def groundable(triaged: DataFrame) -> DataFrame:
    """The hypotheses that can go on to a proposed workflow and its validation: a claim can be made and the estimator is known."""
    return triaged.where(F.col("found") & (F.col("claim") != OTHERWISE))
