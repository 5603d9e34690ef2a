"""One object for a graph, whose methods give DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix import reports
from lattix.operators import audit, contract, fingerprint, planner, traverse, verdict
from lattix.sources import kgx
from lattix.sources.store import read_graph, write_graph


class PropertyGraph:
    def __init__(self, spark: SparkSession, entity: DataFrame, rel: DataFrame):
        self.spark, self.entity, self.rel = spark, entity, rel

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PropertyGraph:
        return cls(spark, *read_graph(spark, path))

    def save(self, path: str) -> dict[str, int]:
        return write_graph(self.entity, self.rel, path)

    def _ids(self, ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    def resolve_method_ids(self, keywords: list[str]) -> DataFrame:
        return traverse.resolve_keywords(self.entity, self.rel, keywords)

    def resolve_skill_ids(self, keywords: list[str]) -> DataFrame:
        return traverse.with_all_keywords(traverse.of_kind(self.entity, "Skill"), keywords).select("id").orderBy("id")

    def subgraph(self, ids: list[str], k: int = 1) -> tuple[DataFrame, DataFrame]:
        return traverse.seed_subgraph(self.entity, self.rel, self._ids(ids), k)

    def retrieve_context(self, ids: list[str], k: int = 1) -> str:
        """The text around some nodes; empty without seeds.  The seeds bound its size."""
        if not ids:
            return ""
        return "\n".join(self.context_lines(self._ids(ids), k))

    def context_lines(self, seeds: DataFrame, k: int = 1) -> Iterator[str]:
        """The lines of the text around the nodes of a table (id), one by one."""
        lines = traverse.context_text(self.entity, self.rel, seeds.select("id"), k).orderBy("ord")
        return (r["line"] for r in lines.toLocalIterator())

    def neighbourhood(self, method_id: str) -> DataFrame:
        self._known(method_id)
        return traverse.neighbourhood(self.entity, self.rel).where(F.col("method_id") == method_id)

    def _known(self, id_: str) -> None:
        if self.entity.where(F.col("id") == id_).isEmpty():
            raise KeyError(id_)

    def contracts(self) -> DataFrame:
        return contract.contracts(self.entity, self.rel)

    def method_preconditions(self, method_id: str) -> DataFrame:
        self._known(method_id)
        return self.contracts().where(F.col("method_id") == method_id).orderBy("assumption", "source")

    def skill_preconditions(self, skill_id: str) -> DataFrame:
        return contract.merge_contracts(self.contracts(), traverse.skill_methods(self.rel).where(F.col("skill_id") == skill_id))

    def evaluate(self, *, method: str | None = None, skill: str | None = None, analysis: list[str] | None = None, facts: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(verdict, gates) of a skill, a method, or the first method that keywords find."""
        if skill:
            owner, rows, name = skill, self.skill_preconditions(skill), "skill_id"
        elif method or analysis:
            if not method:
                methods = traverse.of_kind(self.entity, "Method").select("id")
                found = self.resolve_method_ids(analysis).join(methods, "id", "left_semi").orderBy("ord").first()
                method = found["id"] if found else ""
            owner, rows, name = method, self.contracts().where(F.col("method_id") == method), "method_id"
        else:
            raise ValueError("a skill, a method or keywords are needed")
        given = self.spark.createDataFrame([(owner, k, int(v)) for k, v in (facts or {}).items()], f"{name} string, key string, value long")
        gates = verdict.gates(rows, given, owner=name)
        return verdict.verdicts(self._ids([owner]).select(F.col("id").alias(name)), gates, owner=name), gates

    def evaluate_chain(self, methods: list[str], facts: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(chain, steps, handoffs) of methods one after the other, all with the same facts."""
        steps = self.spark.createDataFrame([("chain", k, m) for k, m in enumerate(methods, 1)], "chain string, ord int, method_id string")
        own = steps.select("method_id").distinct()
        given = own.crossJoin(self.spark.createDataFrame([(k, int(v)) for k, v in (facts or {}).items()], "key string, value long"))
        gates = verdict.gates(self.contracts().join(own, "method_id", "left_semi"), given)
        verdicts = verdict.verdicts(own, gates)
        handed = verdict.handoffs(steps, self.rel, verdicts.where(F.col("status") != verdict.NOT_EVALUABLE))
        return verdict.chain_verdicts(self._ids(["chain"]).select(F.col("id").alias("chain")), steps, verdicts, handed), steps.join(verdicts, "method_id").select("ord", "method_id", "status"), handed

    def skill_coverage(self) -> DataFrame:
        """How many of the methods that each skill wraps have a verdict without facts."""
        none = self.spark.createDataFrame([], "method_id string, key string, value long")
        methods = traverse.of_kind(self.entity, "Method").select(F.col("id").alias("method_id"))
        return audit.skill_coverage(self.entity, self.rel, verdict.verdicts(methods, verdict.gates(self.contracts(), none)))

    def score_method(self, method_id: str, keywords: list[str] | None = None) -> float:
        """Names are not scored: every method is as good as another."""
        return 0.0

    def audit_report(self) -> str:
        counts = {"nodes": self.entity.count(), "edges": self.rel.count()}
        return reports.audit_text(self.audit().collect(), self.coverage().collect(), audit.same_as_basis(self.rel).collect(), counts)

    def suggest(self, frontier: list[str], *, limit: int = 10, exclude: list[str] | None = None) -> DataFrame:
        return planner.suggest(self.entity, self.rel, self._ids(frontier), limit=limit, exclude=self._ids(exclude) if exclude else None)

    def catalogue(self) -> DataFrame:
        """One record per method: its operations as tags, what it reads and writes by name, its first container, and how
        reproducible and documented that makes it."""
        n = traverse.neighbourhood(self.entity, self.rel, direct=True, buckets=("operations", "packages", "inputs", "outputs"))
        named = lambda b: F.array_sort(F.collect_set(F.when(F.col("bucket") == b, F.col("name")))).alias(b)
        per = n.groupBy("method_id").agg(named("operations"), named("inputs"), named("outputs"), F.min(F.when(F.col("bucket") == "packages", F.struct("id", "name")))["name"].alias("container"))
        m = traverse.of_kind(self.entity, "Method").select(F.col("id").alias("method_id"), "name", F.get_json_object("properties", "$.description").alias("description"))
        m = m.join(per, "method_id", "left")
        return m.withColumn("reproducibility", F.when(F.col("container").isNotNull(), 0.8).otherwise(0.5)).withColumn("documentation", F.when(F.coalesce("description", F.lit("")) != "", 0.7).otherwise(0.4))

    def audit(self) -> DataFrame:
        return audit.invariants(self.entity, self.rel)

    def coverage(self) -> DataFrame:
        return audit.coverage(self.entity, self.rel)

    def fingerprint(self, *, runs: bool = False) -> str:
        """The digest of all sorted lines, hashed in order on the driver; with ``runs`` another one, made by all tasks."""
        digest = fingerprint.graph_runs_fingerprint if runs else fingerprint.graph_fingerprint
        return digest(self.entity, self.rel).first()["fingerprint"]

    def export_kgx(self, path: str) -> dict[str, int]:
        return kgx.export_kgx(self.entity, self.rel, path)
