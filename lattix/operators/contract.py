"""Precondition contracts: which assumptions a method's statistics bring along, and how they can be checked.

A contract row is one (owner, assumption, source): ``used`` for the statistics that a method computes, ``amenable`` for
those that its operations would allow downstream.  Contracts of all methods are one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.traverse import of_kind
from lattix.plans.runtime import spread_join

MAX_FILES = 1_000
DIMENSIONS = ["min_replicates_per_group", "min_peptides_per_protein"]


def _edges(rel: DataFrame, kind: str, a: str, b: str) -> DataFrame:
    return of_kind(rel, kind).select(F.col("from_id").alias(a), F.col("to_id").alias(b))


def _requirements(rel: DataFrame) -> DataFrame:
    """(stat_id, assumption_id, evidence)"""
    evidence = F.coalesce(F.get_json_object("properties", "$.evidence"), F.lit(""))
    return of_kind(rel, "REQUIRES_ASSUMPTION").select(F.col("from_id").alias("stat_id"), F.col("to_id").alias("assumption_id"), evidence.alias("evidence"))


def _diagnostics(entity: DataFrame, rel: DataFrame) -> DataFrame:
    """(assumption_id, diagnostic_id, diagnostic, checkable, scope and floors) of every check."""
    number = lambda k: F.get_json_object("properties", f"$.{k}").cast("long").alias(k)
    text = lambda k, n: F.coalesce(F.get_json_object("properties", f"$.{k}"), F.lit("")).alias(n)
    about = of_kind(entity, "Diagnostic").select(
        F.col("id").alias("diagnostic_id"), F.col("name").alias("diagnostic"), text("checkable", "checkable"), text("applies_to_assumption", "scope"), *map(number, DIMENSIONS)
    )
    return _edges(rel, "CHECKED_BY", "assumption_id", "diagnostic_id").distinct().join(about, "diagnostic_id")


def contract_rows(entity: DataFrame, rel: DataFrame) -> DataFrame:
    """One row per path and diagnostic: method_id, source, assumption_id, assumption, via_id, via, evidence, and the diagnostic
    with its checkable phase, scope and floors (null without one).  ``contracts`` gives the same folded, without these rows.
    Names and diagnostics are joined to requirements and operations; methods come in last, so that their rows, as many as
    methods times what their operations allow, are never shuffled."""
    names = entity.select("id", "name")
    requires = _requirements(rel)
    found = _diagnostics(entity, rel)

    def told(df: DataFrame, via_id: str) -> DataFrame:
        x = df.join(names.select(F.col("id").alias(via_id), F.col("name").alias("via")), via_id)
        return x.join(names.select(F.col("id").alias("assumption_id"), F.col("name").alias("assumption")), "assumption_id").join(found, "assumption_id", "left")

    cols = ["method_id", "assumption_id", "evidence", "via", "assumption", *found.drop("assumption_id").columns]
    shown = lambda df, source, via_id: df.select(*cols[:2], F.lit(source).alias("source"), F.col(via_id).alias("via_id"), *cols[2:])
    uses = _edges(rel, "USES_STATISTICAL_METHOD", "method_id", "stat_id").repartition("stat_id").distinct()
    by_op = _edges(rel, "AMENABLE_TO", "op_id", "stat_id").join(requires, "stat_id").select("op_id", "assumption_id", "evidence").distinct()
    allowed = spread_join(_edges(rel, "PERFORMS", "method_id", "op_id").distinct(), told(by_op, "op_id"), "op_id")
    return shown(uses.join(told(requires, "stat_id"), "stat_id"), "used", "stat_id").unionByName(shown(allowed, "amenable", "op_id"))


def phase_of(rank):
    return F.when(rank == 2, "pre_run").when(rank == 1, "post_run").otherwise("")


def rank_of(phase):
    return F.when(phase == "pre_run", 2).when(phase == "post_run", 1).otherwise(0)


def checks(entity: DataFrame, rel: DataFrame) -> DataFrame:
    """One row per assumption that has diagnostics: rank of the best phase, the diagnostics in order, and as a floor the
    strictest of those whose scope is empty or this very assumption."""
    fits = (F.col("scope") == "") | (F.col("scope") == F.col("assumption_id"))
    return _diagnostics(entity, rel).groupBy("assumption_id").agg(
        F.max(rank_of(F.col("checkable"))).alias("rank"), F.array_sort(F.collect_set("diagnostic_id")).alias("diagnostics"), *(F.max(F.when(fits, F.col(d))).alias(d) for d in DIMENSIONS)
    )


def contracts(entity: DataFrame, rel: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """One row per method_id, assumption_id and source: assumption, evidence (the first that is there, by the via name), via,
    diagnostics, floors and checkable.  What depends on an operation or an assumption alone is folded before the methods
    come in, so a method meets one row for each and no text of a diagnostic is shuffled with it.  Rows come partitioned by
    method; what is known of an operation's or a method's assumptions has as many rows as there are assumptions, for each
    operation or in all, and is broadcast.  With ``methods`` only the contracts of those (method_id) are made."""
    names = entity.select("id", "name")
    named = lambda df, key, n: df.join(names.select(F.col("id").alias(key), F.col("name").alias(n)), key)
    requires = _requirements(rel)
    first = lambda *c: F.min(F.when(F.col("evidence") != "", F.struct(*c)))
    of = lambda df: df if methods is None else df.join(methods.select("method_id").distinct(), "method_id", "left_semi")
    uses = of(_edges(rel, "USES_STATISTICAL_METHOD", "method_id", "stat_id")).repartition("stat_id").distinct()
    used = uses.join(named(requires, "stat_id", "via"), "stat_id").select("method_id", F.lit("used").alias("source"), "assumption_id", "via", "evidence")
    by_op = _edges(rel, "AMENABLE_TO", "op_id", "stat_id").join(requires, "stat_id").groupBy("op_id", "assumption_id").agg(F.coalesce(first("evidence")["evidence"], F.lit("")).alias("evidence"))
    allowed = of(_edges(rel, "PERFORMS", "method_id", "op_id")).distinct().join(F.broadcast(named(by_op, "op_id", "via")), "op_id").select("method_id", F.lit("amenable").alias("source"), "assumption_id", "via", "evidence")
    folded = used.unionByName(allowed).repartition("method_id").groupBy("method_id", "assumption_id", "source").agg(
        F.coalesce(first("via", "evidence")["evidence"], F.lit("")).alias("evidence"), F.array_sort(F.collect_set("via")).alias("via")
    )
    about = named(requires.select("assumption_id").distinct(), "assumption_id", "assumption").join(checks(entity, rel), "assumption_id", "left")
    folded = folded.join(F.broadcast(about), "assumption_id")
    none = F.array().cast("array<string>")
    return folded.select(
        "method_id", "assumption_id", "source", "assumption", "evidence", "via", F.coalesce("diagnostics", none).alias("diagnostics"), *DIMENSIONS, phase_of(F.coalesce("rank", F.lit(0))).alias("checkable")
    )


def diagnostics_of(contracts: DataFrame) -> DataFrame:
    """(method_id, diagnostic_id, checks): what each diagnostic checks, per method."""
    x = contracts.select("method_id", "assumption", F.explode("diagnostics").alias("diagnostic_id"))
    return x.groupBy("method_id", "diagnostic_id").agg(F.array_sort(F.collect_set("assumption")).alias("checks"))


def merge_contracts(contracts: DataFrame, members: DataFrame, owner: str = "skill_id") -> DataFrame:
    """Contracts of owners made of several methods: (owner, ord, method_id) members.  Floors and phases are the
    strictest, diagnostics all together in order; name, evidence and via are those of the first member that has the row."""
    x = members.join(contracts, "method_id")
    first = lambda c: F.min_by(c, "ord").alias(c)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "diagnostics"))), lambda s: s["diagnostics"])
    return (
        x.groupBy(owner, "assumption_id", "source")
        .agg(
            first("assumption"),
            first("evidence"),
            first("via"),
            F.max(rank_of(F.col("checkable"))).alias("rank"),
            F.array_distinct(F.flatten(listed)).alias("diagnostics"),
            *(F.max(d).alias(d) for d in DIMENSIONS),
        )
        .withColumn("checkable", phase_of(F.col("rank")))
        .drop("rank")
    )


def evidence_sources(contracts: DataFrame, files: DataFrame) -> DataFrame:
    """(method_id, assumption_id, evidence, path): every curated file whose text holds the bare evidence id.
    There are a handful of files, so they are broadcast; more than ``MAX_FILES`` are an error."""
    if (n := files.count()) > MAX_FILES:
        raise ValueError(f"{n} files are too many to search for every piece of evidence")
    bare = F.regexp_replace("evidence", "^[a-z]+:", "")
    x = contracts.where("evidence <> ''").select("method_id", "assumption_id", "evidence", bare.alias("bare"))
    return x.join(F.broadcast(files.select("path", "text")), F.contains("text", F.col("bare"))).select("method_id", "assumption_id", "evidence", "path")


def ordered(contracts: DataFrame, owner: str = "method_id") -> DataFrame:
    return contracts.withColumn("ord", F.row_number().over(Window.partitionBy(owner).orderBy("assumption", "source", "assumption_id")))
