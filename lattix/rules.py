"""Portable rules: contracts and verdicts from the curated files alone, without a built graph.

Only the statistics that a method uses count, as only those can block.  Where a floor applies, the evidence is that of
the diagnostic which sets it; both spellings of an assumption, with and without its prefix, mean the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.operators import verdict
from lattix.operators.contract import DIMENSIONS, phase_of, rank_of
from lattix.sources import curated


def slug(column: Column) -> Column:
    return F.regexp_replace(column, "^assum:", "")


def evidence_of(value) -> str:
    """A token as it is; of a mapping, the doi before the url before the pmid."""
    if isinstance(value, dict):
        return next((f"{k}:{value[k]}" for k in ("doi", "url", "pmid") if value.get(k)), "")
    return value if isinstance(value, str) else ""


@dataclass
class Rules:
    spark: SparkSession
    uses: DataFrame  # ord, method_id, stat_id, label
    requires: DataFrame  # ord, stat_id, assumption_id, evidence
    names: DataFrame  # assumption_id, name
    diagnostics: DataFrame  # diagnostic_id, check, checkable, scope, ref and floors

    def method_ids(self) -> list[str]:
        return [r[0] for r in self.uses.select("method_id").distinct().orderBy("method_id").collect()]

    def contracts(self) -> DataFrame:
        """The contracts of all curated methods, in the columns of ``lattix.operators.contract.contracts``."""
        x = self.uses.join(self.requires, "stat_id").groupBy("method_id", "assumption_id").agg(
            F.min_by("evidence", F.struct("use", "need")).alias("own"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("use", "need", "label"))), lambda s: s["label"])).alias("via")
        )
        fits = (F.col("scope") == "") | (slug(F.col("scope")) == F.col("slug"))
        floor = F.lit(False)
        for d in DIMENSIONS:
            floor |= F.col(d).isNotNull()
        checks = self.diagnostics.withColumn("slug", slug(F.col("check"))).groupBy("slug").agg(
            F.max(rank_of(F.col("checkable"))).alias("rank"), F.array_sort(F.collect_set("diagnostic_id")).alias("diagnostics"),
            F.max_by("ref", F.when(fits & floor & (F.col("ref") != ""), F.col("diagnostic_id"))).alias("floor_ref"), *(F.max(F.when(fits, F.col(d))).alias(d) for d in DIMENSIONS),
        )
        x = x.withColumn("slug", slug(F.col("assumption_id"))).join(checks, "slug", "left").join(self.names, "assumption_id", "left")
        none = F.array().cast("array<string>")
        return x.select(
            "method_id", "assumption_id", F.lit("used").alias("source"), F.coalesce("name", "slug").alias("assumption"), F.coalesce("floor_ref", "own").alias("evidence"), "via",
            F.coalesce("diagnostics", none).alias("diagnostics"), *DIMENSIONS, phase_of(F.coalesce("rank", F.lit(0))).alias("checkable"),
        )

    def method_preconditions(self, method_id: str) -> DataFrame:
        """A method's contract; ``KeyError`` for a method without a curated statistic."""
        if self.uses.where(F.col("method_id") == method_id).isEmpty():
            raise KeyError(method_id)
        return self.contracts().where(F.col("method_id") == method_id).orderBy("assumption")

    def evaluate(self, method_id: str, facts: dict[str, int]) -> tuple[DataFrame, DataFrame]:
        """(verdict, gates) of a method."""
        rows = self.method_preconditions(method_id)
        given = self.spark.createDataFrame([(method_id, k, int(v)) for k, v in facts.items()], "method_id string, key string, value long")
        gates = verdict.gates(rows, given)
        return verdict.verdicts(self.spark.createDataFrame([(method_id,)], "method_id string"), gates), gates


def load_rules(spark: SparkSession, folder: str) -> Rules:
    """The rules of a folder of curated files; unlike a build, this takes the files as they are."""
    links = curated.read_yaml(spark, folder, curated.LAYERS["method_statistics"][0]).get("links") or []
    doc = curated.read_yaml(spark, folder, curated.ASSUMPTIONS)
    uses = [(k, x["method"], x["statistical_method"], x.get("label") or x["statistical_method"]) for k, x in enumerate(links)]
    requires = [(k, x["statistical_method"], x["assumption"], evidence_of(x.get("evidence"))) for k, x in enumerate(doc.get("requires") or [])]
    names = [(x["id"], x.get("name", "")) for x in doc.get("assumptions") or []]
    found = (curated.read_yaml(spark, folder, curated.DIAGNOSTICS).get("diagnostics") or {}).items()
    rows = [
        (f"diag:{n}", str(c), str(d.get("checkable") or ""), str(d.get("applies_to_assumption") or ""), evidence_of(d.get("ref")), *(d.get(k) for k in DIMENSIONS))
        for n, d in found for c in d.get("checks") or []
    ]
    return Rules(
        spark,
        spark.createDataFrame(uses, "use int, method_id string, stat_id string, label string"),
        spark.createDataFrame(requires, "need int, stat_id string, assumption_id string, evidence string"),
        spark.createDataFrame(names, "assumption_id string, name string"),
        spark.createDataFrame(rows, "diagnostic_id string, check string, checkable string, scope string, ref string, " + ", ".join(f"{d} long" for d in DIMENSIONS)),
    )
