"""Verdicts on steps and chains of steps, from contracts and measured facts.

Facts are rows (owner, key, value); keys are the contract's floors without ``min_``.  Presence facts hold 0 or 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.contract import DIMENSIONS
from lattix.operators.traverse import of_kind

# The words of a verdict.
EVALUABLE, BLOCKED, NOT_EVALUABLE, FACTS_REQUIRED = "EVALUABLE", "BLOCKED", "NOT_EVALUABLE", "FACTS_REQUIRED"
PASS, FAIL, MISSING, REVIEW = "PASS", "FAIL", "INSUFFICIENT_INFO", "REQUIRES_REVIEW"
VALID, BROKEN, UNKNOWN = "VALID", "BROKEN", "UNKNOWN"
NO_COVERAGE = "no evaluability coverage for this method"


def fact_key(column: Column) -> Column:
    return F.regexp_replace(column, "^min_", "")


def gates(contracts: DataFrame, facts: DataFrame, *, requires: DataFrame | None = None, owner: str = "method_id") -> DataFrame:
    """One row per gate: owner, assumption, phase, key, threshold, supplied, result, evidence, diagnostics.  Rows of phase
    ``post_run`` are checks for afterwards and have no result.  ``requires`` may hold presence gates (owner,
    assumption_id, source, key, expected)."""
    cols = [owner, "assumption_id", "assumption", "source", "checkable", "evidence", "diagnostics"]
    floors = F.filter(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("floor")) for d in DIMENSIONS)), lambda x: x["floor"].isNotNull())
    rows = contracts.select(*cols, floors.alias("floors"))
    if requires is not None:
        asked = requires.groupBy(owner, "assumption_id", "source").agg(F.array_sort(F.collect_list(F.struct("key", "expected"))).alias("asked"))
        rows = rows.join(asked, [owner, "assumption_id", "source"], "left")
    else:
        rows = rows.withColumn("asked", F.lit(None).cast("array<struct<key:string,expected:boolean>>"))
    pre = (F.col("checkable") == "pre_run") & (F.col("source") != "amenable")
    key = lambda k, t, p: F.struct(k.alias("key"), t.alias("threshold"), F.lit(p).alias("presence"))
    none = F.array(key(F.lit(None).cast("string"), F.lit(None).cast("long"), False))
    what = (
        F.when(pre & (F.size("floors") > 0), F.transform("floors", lambda x: key(fact_key(x["dim"]), x["floor"], False)))
        .when(pre & (F.size("asked") > 0), F.transform("asked", lambda x: key(x["key"], x["expected"].cast("long"), True)))
        .otherwise(none)
    )
    rows = rows.select(*cols, F.explode(what).alias("g")).select(*cols, "g.*")
    # an owner's facts come by owner alone, so rows that are partitioned by owner stay where they are up to the verdict
    told = facts.groupBy(owner).agg(F.collect_list(F.struct("key", "value")).alias("told"))
    mine = F.transform(F.filter("told", lambda x: x["key"] == F.col("key")), lambda x: x["value"])
    rows = rows.join(told, owner, "left").withColumn("supplied", F.explode_outer(mine)).drop("told")
    phase = F.when(F.col("checkable") == "post_run", "post_run").otherwise("pre_run")
    enough = F.when(F.col("presence"), (F.col("supplied") != 0) == (F.col("threshold") != 0)).otherwise(F.col("supplied") >= F.col("threshold"))
    result = F.when(phase == "post_run", None).when(F.col("key").isNull(), REVIEW).when(F.col("supplied").isNull(), MISSING).when(enough, PASS).otherwise(FAIL)
    rows = rows.withColumn("phase", phase).withColumn("result", result)
    # a review of what already has a keyed gate says nothing more, and a gate that comes twice is shown once
    # (both windows go by one sort: a group of one key is shown or left out as a whole)
    same = F.when(F.col("phase") == "post_run", F.array_join("diagnostics", ",")).otherwise(F.concat(F.lit("key "), "key"))
    rows = rows.withColumn("same", same)
    once = Window.partitionBy(owner, "assumption", "phase", "same").orderBy(F.desc("source"), "assumption_id")
    per = Window.partitionBy(owner, "assumption", "phase")
    rows = rows.withColumn("n", F.row_number().over(once)).withColumn("keyed", F.max(F.col("key").isNotNull()).over(per))
    rows = rows.where("n = 1 and (phase = 'post_run' or key is not null or not keyed)")
    return rows.select(owner, "assumption", "phase", "key", "threshold", "supplied", "result", "evidence", "diagnostics")


def verdicts(owners: DataFrame, all_gates: DataFrame, *, owner: str = "method_id") -> DataFrame:
    """One row per owner: status, refusal_reason, required_facts and counts of its gates."""
    count = lambda r: F.count_if(F.col("result") == r)
    sums = all_gates.groupBy(owner).agg(
        count(PASS).alias("n_pass"), count(FAIL).alias("n_fail"), count(MISSING).alias("n_missing"), count(REVIEW).alias("n_review"),
        F.count_if(F.col("phase") == "post_run").alias("n_post_run"), F.array_sort(F.collect_set("key")).alias("required_facts"),
    )
    x = owners.select(owner).distinct().join(sums, owner, "left")
    status = F.when(F.col("n_fail").isNull(), NOT_EVALUABLE).when(F.col("n_fail") > 0, BLOCKED).when(F.col("n_missing") > 0, FACTS_REQUIRED).otherwise(EVALUABLE)
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_pass", "n_fail", "n_missing", "n_review", "n_post_run")]
    return x.select(
        owner, status.alias("status"), F.when(F.col("n_fail").isNull(), NO_COVERAGE).alias("refusal_reason"), *zero, F.coalesce("required_facts", F.array().cast("array<string>")).alias("required_facts")
    )


def handoff(outputs: Column, inputs: Column) -> Column:
    """VALID, BROKEN or UNKNOWN for what one step writes and the next reads."""
    none = (F.size(F.coalesce(outputs, F.array())) == 0) | (F.size(F.coalesce(inputs, F.array())) == 0)
    return F.when(none, UNKNOWN).when(F.size(F.array_intersect(outputs, inputs)) > 0, VALID).otherwise(BROKEN)


def data_ids(rel: DataFrame, kind: str, name: str) -> DataFrame:
    """(method_id, <name>): the typed data that methods read or write; formats don't count."""
    x = of_kind(rel, kind).where(F.col("to_id").startswith("data:"))
    return x.groupBy(F.col("from_id").alias("method_id")).agg(F.array_sort(F.collect_set("to_id")).alias(name))


def handoffs(steps: DataFrame, rel: DataFrame, evaluable: DataFrame | None = None) -> DataFrame:
    """(chain, ord, method_id, next_method_id, handoff, shared) for consecutive steps of (chain, ord, method_id) rows.
    With ``evaluable``, the data of methods outside it stays unknown."""
    x = steps.join(data_ids(rel, "INPUT", "reads"), "method_id", "left").join(data_ids(rel, "OUTPUT", "writes"), "method_id", "left")
    if evaluable is not None:
        some = evaluable.select("method_id").distinct().withColumn("seen", F.lit(True))
        x = x.join(some, "method_id", "left")
        x = x.withColumn("reads", F.when(F.col("seen"), F.col("reads"))).withColumn("writes", F.when(F.col("seen"), F.col("writes")))
    w = Window.partitionBy("chain").orderBy("ord")
    x = x.withColumn("next_method_id", F.lead("method_id").over(w)).withColumn("next_reads", F.lead("reads").over(w)).where("next_method_id is not null")
    return x.select("chain", "ord", "method_id", "next_method_id", handoff(F.col("writes"), F.col("next_reads")).alias("handoff"), F.array_sort(F.array_intersect("writes", "next_reads")).alias("shared"))


def chain_verdicts(chains: DataFrame, steps: DataFrame, step_verdicts: DataFrame, step_handoffs: DataFrame) -> DataFrame:
    """One row per chain: a blocked step or a broken handoff blocks, then an unknown step, then missing facts; unknown
    handoffs never block, and a chain without steps is evaluable."""
    s = steps.join(step_verdicts.select("method_id", "status"), "method_id", "left").groupBy("chain").agg(
        F.count("*").alias("n_steps"), F.count_if(F.col("status") == BLOCKED).alias("n_blocked"),
        F.count_if(F.coalesce("status", F.lit(NOT_EVALUABLE)) == NOT_EVALUABLE).alias("n_unknown"), F.count_if(F.col("status") == FACTS_REQUIRED).alias("n_facts"),
    )
    h = step_handoffs.groupBy("chain").agg(F.count_if(F.col("handoff") == BROKEN).alias("n_broken"), F.count_if(F.col("handoff") == VALID).alias("n_valid"))
    x = chains.select("chain").distinct().join(s, "chain", "left").join(h, "chain", "left").na.fill(0)
    status = (
        F.when((F.col("n_blocked") > 0) | (F.col("n_broken") > 0), BLOCKED).when(F.col("n_unknown") > 0, NOT_EVALUABLE).when(F.col("n_facts") > 0, FACTS_REQUIRED).otherwise(EVALUABLE)
    )
    return x.select("chain", "n_steps", "n_blocked", "n_unknown", "n_facts", "n_broken", "n_valid", status.alias("status"))
