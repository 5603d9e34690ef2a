"""Facts about a dataset that verdicts can rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that may name a sample's condition, in order of preference.
CONDITION_COLUMNS = ["condition", "group", "treatment", "sample_group", "genotype"]


def smallest_arm(samples: DataFrame, column: str) -> DataFrame:
    """One row (smallest_arm, n_arms): the size of the least frequent condition."""
    return samples.groupBy(column).agg(F.count("*").alias("n")).agg(F.min("n").alias("smallest_arm"), F.count("*").alias("n_arms"))


def condition_column(samples: DataFrame) -> str | None:
    names = {c.lower(): c for c in samples.columns}
    return next((names[c] for c in CONDITION_COLUMNS if c in names), None)
