"""Planning and validating workflows on the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.traverse import members, of_kind, resolve_keywords, seed_subgraph
from lattix.plans.runtime import cut


def continuations(entity: DataFrame, rel: DataFrame, frontier: DataFrame) -> DataFrame:
    """(module_id, count, via, why) of modules downstream of the frontier's, each by its best-attested edge."""
    flow = of_kind(rel, "DOWNSTREAM_OF")
    props = F.col("properties")
    pipelines = F.size(F.from_json(F.get_json_object(props, "$.pipelines"), "array<string>"))
    n = F.coalesce(F.get_json_object(props, "$.attestations").cast("long"), pipelines.cast("long"), F.lit(0).cast("long"))
    x = members(flow.select("from_id", "to_id", n.alias("count")), "from_id", frontier)
    x = members(x, "to_id", of_kind(entity, "Module"))
    best = x.groupBy("to_id").agg(F.min(F.struct((-F.col("count")).alias("neg"), "from_id")).alias("b"))
    return best.select(F.col("to_id").alias("module_id"), (-F.col("b.neg")).alias("count"), F.col("b.from_id").alias("via"), F.lit("downstream").alias("why"))


def entries(entity: DataFrame, rel: DataFrame, frontier: DataFrame) -> DataFrame:
    """(module_id, count, via, why) of modules that wrap a method reading the frontier's data; the count is how many
    pipelines have the module."""
    reads = members(of_kind(rel, "INPUT"), "to_id", frontier).select(F.col("from_id").alias("method_id"), F.col("to_id").alias("via"))
    wraps = of_kind(rel, "WRAPS").select(F.col("from_id").alias("module_id"), F.col("to_id").alias("method_id"))
    x = members(wraps.join(reads, "method_id"), "module_id", of_kind(entity, "Module")).groupBy("module_id").agg(F.min("via").alias("via"))
    used = of_kind(rel, "HAS_MODULE").groupBy(F.col("to_id").alias("module_id")).agg(F.count_distinct("from_id").alias("count"))
    return x.join(used, "module_id", "left").select("module_id", F.coalesce("count", F.lit(0)).alias("count"), "via", F.lit("entry").alias("why"))


def executors(entity: DataFrame, rel: DataFrame) -> DataFrame:
    """(module_id, method_id, alternatives, container): a module runs its first method by id, in its first container."""
    wraps = of_kind(rel, "WRAPS").select(F.col("from_id").alias("module_id"), F.col("to_id").alias("method_id")).distinct()
    by_module = members(wraps, "method_id", of_kind(entity, "Method")).groupBy("module_id").agg(F.min("method_id").alias("method_id"), (F.count("*") - 1).alias("alternatives"))
    image = F.coalesce(F.nullif(F.get_json_object("properties", "$.image_name"), F.lit("")), F.col("name"))
    containers = of_kind(entity, "Container").select(F.col("id").alias("to_id"), image.alias("image"))
    packed = of_kind(rel, "PACKAGED_AS").join(containers, "to_id").groupBy(F.col("from_id").alias("method_id")).agg(F.min_by("image", "to_id").alias("container"))
    return by_module.join(packed, "method_id", "left")


def suggest(entity: DataFrame, rel: DataFrame, frontier: DataFrame, *, limit: int = 10, exclude: DataFrame | None = None) -> DataFrame:
    """The next steps, best attested first, then by id.  A module that both continues and enters counts as an entry only if
    that is attested more often; modules without a method to run are passed over before the limit counts."""
    every = continuations(entity, rel, frontier).unionByName(entries(entity, rel, frontier))
    w = Window.partitionBy("module_id").orderBy(F.desc("count"), "why")
    best = every.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    for drop in (frontier, exclude):
        if drop is not None:
            best = best.join(drop.select(F.col("id").alias("module_id")), "module_id", "left_anti")
    best = best.join(executors(entity, rel), "module_id").orderBy(F.desc("count"), "module_id").limit(limit)
    said = F.when(F.col("why") == "downstream", F.format_string("follows %s in %d pipelines", "via", "count")).otherwise(F.format_string("reads %s, in %d pipelines", "via", "count"))
    return best.select(F.row_number().over(Window.orderBy(F.desc("count"), "module_id")).alias("ord"), "module_id", "count", "method_id", "alternatives", "container", said.alias("why"))


def frontier_of_labels(entity: DataFrame, rel: DataFrame, labels: list[str], data_id: str = "") -> DataFrame:
    """(ord, id): where to start for a causal edge: the data's id, then the modules around the words of its labels."""
    import re

    words = list(dict.fromkeys(w for label in labels for w in re.split(r"[ _-]+", label) if w))
    found = resolve_keywords(entity, rel, words)
    modules = of_kind(rel, "WRAPS").join(found.select(F.col("id").alias("to_id"), "ord"), "to_id").where(F.col("from_id").startswith("mod:"))
    out = modules.groupBy(F.col("from_id").alias("id")).agg(F.min("ord").alias("ord")).select("ord", "id")
    return entity.sparkSession.createDataFrame([(0, data_id)], "ord int, id string").where("id <> ''").unionByName(out)


def allowed_methods(entity: DataFrame, rel: DataFrame, seeds: DataFrame, k: int = 1) -> DataFrame:
    """The methods inside the seeds' subgraph."""
    return of_kind(seed_subgraph(entity, rel, seeds, k)[0], "Method").select("id")


def validate(entity: DataFrame, rel: DataFrame, steps: DataFrame, artifacts: DataFrame, decisions: DataFrame, *, allowed: DataFrame | None = None, approved: DataFrame | None = None) -> DataFrame:
    """All issues of proposed workflows: (workflow, step_ord, check_ord, code, step_id, subject).

    steps: workflow, step_ord, step_id, method_id, container, inputs, outputs, evidence (arrays);
    artifacts: workflow, artifact_id, format, produced_by; decisions: workflow, decision_id, inputs, leads_to (arrays).
    A step meets what is known of its method once, its items the artifacts of their workflow once."""
    key = ["workflow", "step_ord", "step_id"]
    steps = cut(steps.join(_method_facts(entity, rel, allowed, approved), "method_id", "left"))  # asked several times

    def issue(df: DataFrame, order, code, subject) -> DataFrame:
        literal = lambda x: F.lit(x) if isinstance(x, (int, str)) else x
        return df.select(*key, literal(order).cast("int").alias("check_ord"), literal(code).alias("code"), subject.alias("subject"))

    found, absent = steps.where("known"), lambda s, x: ~F.coalesce(F.array_contains(s, x), F.lit(False))
    out = issue(steps.where("known is null"), 1, "method_not_found", F.col("method_id"))
    if allowed is not None:
        out = out.unionByName(issue(found.where("ok is null"), 2, "method_not_allowed", F.col("method_id")))
    out = out.unionByName(issue(found.where("container <> ''").where(absent(F.col("packed"), F.col("container"))), 3, "container_not_packaged", F.col("container")))
    evidence = found.select(*key, "tied", F.explode("evidence").alias("item"))
    out = out.unionByName(issue(evidence.where(absent(F.col("tied"), F.col("item"))), 4, "evidence_missing", F.col("item")))
    art = artifacts.select("workflow", F.col("artifact_id").alias("item"), "format", "produced_by", F.lit(True).alias("there"))
    role = lambda name, bound, n: F.transform(F.coalesce(name, F.array()), lambda x: F.struct(x.alias("item"), F.lit(n).alias("role"), F.col(bound).alias("bound")))
    items = found.select(*key, F.inline(F.concat(role("inputs", "reads", 0), role("outputs", "writes", 1)))).join(art, ["workflow", "item"], "left")
    wrong, name = (F.col("format") != "") & F.col("bound").isNotNull() & absent(F.col("bound"), F.col("format")), F.when(F.col("role") == 0, "input").otherwise("output")
    said = lambda n, word, when: F.when(when, F.struct((n + F.col("role")).cast("int").alias("check_ord"), F.concat(name, F.lit(word)).alias("code")))
    checks = F.array(
        said(5, "_artifact_unknown", F.col("there").isNull()),
        F.when(F.col("there") & (F.col("role") == 1) & ~F.col("produced_by").eqNullSafe(F.col("step_id")), F.struct(F.lit(7).alias("check_ord"), F.lit("output_not_produced_here").alias("code"))),
        said(8, "_contract_violation", F.col("there") & wrong),
    )
    items = items.select(*key, "item", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("c"))
    out = out.unionByName(issue(items, F.col("c.check_ord"), F.col("c.code"), F.col("item")))
    choice = decisions.select("workflow", F.lit(None).cast("int").alias("step_ord"), F.lit("").alias("step_id"), "inputs", "leads_to")
    asks = choice.select(*key, F.explode("inputs").alias("item"))
    out = out.unionByName(issue(asks.join(art, ["workflow", "item"], "left_anti"), 10, "decision_input_unknown", F.col("item")))
    leads = choice.select(*key, F.explode("leads_to").alias("item")).join(steps.select("workflow", F.col("step_id").alias("item")), ["workflow", "item"], "left_anti")
    return out.unionByName(issue(leads, 11, "decision_leads_to_unknown", F.col("item")))


def _method_facts(entity: DataFrame, rel: DataFrame, allowed: DataFrame | None, approved: DataFrame | None) -> DataFrame:
    """One row per method that exists: ``known``, ``ok`` if it is allowed, what it is packaged as, what is tied to it, and what it
    reads and writes; sets are null where there is nothing."""
    facts = of_kind(entity, "Method").select(F.col("id").alias("method_id"), F.lit(True).alias("known")).distinct()
    ok = [x.select(F.col("id").alias("method_id")) for x in (allowed, approved) if x is not None] if allowed is not None else []
    if ok:
        facts = facts.join(reduce(DataFrame.unionByName, ok).distinct().withColumn("ok", F.lit(True)), "method_id", "left")
    edges = of_kind(rel, "PACKAGED_AS", "PERFORMS", "INPUT", "OUTPUT").select(F.col("from_id").alias("method_id"), "to_id", "kind")
    listed = lambda n, *kinds: F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("to_id"))).alias(n)
    near = edges.groupBy("method_id").agg(listed("packed", "PACKAGED_AS"), listed("reads", "INPUT"), listed("writes", "OUTPUT"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    near = near.select("method_id", *map(some, ("packed", "reads", "writes")))
    tied = members(edges.where("kind <> 'PACKAGED_AS'"), "to_id", entity).groupBy("method_id").agg(F.collect_set("to_id").alias("tied"))
    return facts.join(near, "method_id", "left").join(tied, "method_id", "left")


def with_order(ledger: DataFrame) -> DataFrame:
    """A ledger's entries in the order in which they were recorded."""
    return ledger.withColumn("ord", F.row_number().over(Window.orderBy("recorded_at", "entry_id")))
