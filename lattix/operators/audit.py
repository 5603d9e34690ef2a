"""The audit of a graph: invariants, coverage, consistency and reconciliation, each a small table.

Relations meet the kinds of their starts once, without their texts, and what comes out, summed by end and kind, those of their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.operators.traverse import members, missing_provenance, of_kind
from lattix.plans.runtime import cut
from lattix.schema import ENDPOINTS

# The evidence that each curated kind of edge may rest on.
EVIDENCE = {
    "USES_STATISTICAL_METHOD": ["doi:", "pmid:"],
    "REQUIRES_ASSUMPTION": ["doi:", "pmid:", "url:", "isbn:", "stato:"],
    "AMENABLE_TO": ["doi:", "pmid:"],
    "CHECKED_BY": ["doi:", "pmid:", "url:", "isbn:"],
    "ANALYZED_BY": ["doi:", "pmid:"],
}
DSL = "nextflow_dsl2"


def grounded(evidence: Column, prefixes: list[str] | None = None) -> Column:
    """Whether evidence, trimmed and lower-cased, begins with an allowed prefix; missing evidence doesn't."""
    text = F.lower(F.trim(F.coalesce(evidence, F.lit(""))))
    out = F.lit(False)
    for p in prefixes or EVIDENCE["USES_STATISTICAL_METHOD"]:
        out |= text.startswith(p)
    return out


def attested(properties: Column) -> Column:
    """Whether ``pipelines`` is a non-empty, sorted list of distinct names and ``attestations`` its length."""
    p = F.from_json(F.get_json_object(properties, "$.pipelines"), "array<string>")
    n = F.get_json_object(properties, "$.attestations").cast("long")
    return F.coalesce((F.size(p) > 0) & (F.array_sort(F.array_distinct(p)) == p) & (F.size(p) == n), F.lit(False))


def cycle_residual(edges: DataFrame) -> DataFrame:
    """The nodes of (a, b) edges that repeated removal of nodes without a predecessor never reaches: members of cycles
    and all that lies behind them.  Rounds are as many as the longest path; edges only get fewer."""
    left = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    n = left.count()
    while n:
        kept = cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"))
        m = kept.count()
        if m == n:
            break
        left, n = kept, m
    return left.select(F.col("b").alias("id")).distinct()


def missing_links(entity: DataFrame, rel: DataFrame, links: DataFrame) -> DataFrame:
    """Curated (from_id, to_id, kind, from_kind, to_kind) links whose ends exist with these kinds but that have no edge."""
    a = entity.select(F.col("id").alias("from_id"), F.col("kind").alias("from_kind"))
    b = entity.select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind"))
    sound = links.join(a, ["from_id", "from_kind"], "left_semi").join(b, ["to_id", "to_kind"], "left_semi")
    return sound.join(rel.select("from_id", "to_id", "kind").distinct(), ["from_id", "to_id", "kind"], "left_anti")


def _edge_checks(entity: DataFrame, rel: DataFrame) -> DataFrame:
    """(name, violations) of what is asked of single relations and the kinds of their ends."""
    evidence = F.get_json_object("properties", "$.evidence")
    bare = F.lit(False)
    for kind, prefixes in EVIDENCE.items():
        bare |= (F.col("kind") == kind) & ~grounded(evidence, prefixes)
    flow, blank = F.col("kind") == "DOWNSTREAM_OF", F.lit(False)
    for c in ("source", "source_url", "ingested_at"):
        blank |= F.coalesce(F.col(c), F.lit("")) == ""
    flags = {"bare": bare, "loop": flow & (F.col("from_id") == F.col("to_id")), "unattested": flow & ~attested(F.col("properties")), "blank": blank}
    # the texts stay behind: only what the checks said of them goes on
    edges = rel.select("from_id", "to_id", "kind", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))

    def sound(column: str, end: int):
        out = F.lit(False)
        for kind, ends in ENDPOINTS.items():
            out |= (F.col("kind") == kind) & F.col(column).isin(ends[end])
        return F.coalesce(out, F.lit(False))

    starts = entity.select(F.col("id").alias("from_id"), F.col("kind").alias("from_kind"))
    ends = entity.select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind"))
    by_end = edges.join(starts, "from_id", "left").groupBy("to_id", "kind").agg(F.count("*").alias("n"), F.count_if(sound("from_kind", 0)).alias("started"), *(F.count_if(f).alias(f) for f in flags))
    typed = by_end.join(ends, "to_id", "left").withColumn("misplaced", F.col("n") - F.when(sound("to_kind", 1), F.col("started")).otherwise(0))
    asked = {f"{k}: endpoints": (k, "misplaced") for k in ENDPOINTS} | {"DOWNSTREAM_OF: no self loop": ("DOWNSTREAM_OF", "loop")} | {f"{k}: grounded": (k, "bare") for k in EVIDENCE}
    asked |= {"DOWNSTREAM_OF: attestations": ("DOWNSTREAM_OF", "unattested"), "REL: provenance": (None, "blank")}
    total = lambda kind, c: F.coalesce(F.sum(F.col(c) if kind is None else F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    sums = typed.agg(*(total(*how).alias(f"c{i}") for i, how in enumerate(asked.values())))
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("violations")) for i, n in enumerate(asked)))
    return sums.select(F.explode(pairs).alias("x")).select("x.*")


def invariants(entity: DataFrame, rel: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(name, violations, ok) of every invariant.  A relation counts once for each node that has the id of its start and for
    each that has that of its end, and once where none has."""
    out = _edge_checks(entity, rel)

    def one(name: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")

    out = out.unionByName(one("ENTITY: unique id", entity.groupBy("id").count().where("count > 1")))
    out = out.unionByName(one("ENTITY: provenance", missing_provenance(entity)))
    specs = of_kind(entity, "ExecutionSpec").where(F.coalesce(F.get_json_object("properties", "$.container"), F.lit("")) == "")
    out = out.unionByName(one("ExecutionSpec: container", specs))
    ran = of_kind(rel, "RUNS_AS").select(F.col("to_id").alias("id"))
    out = out.unionByName(one("ExecutionSpec: reached", of_kind(entity, "ExecutionSpec").join(ran, "id", "left_anti")))
    flow = of_kind(rel, "DOWNSTREAM_OF").where(F.get_json_object("properties", "$.derivation") == DSL)
    out = out.unionByName(one("DOWNSTREAM_OF: acyclic", cycle_residual(flow.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))))
    if links is not None:
        out = out.unionByName(one("curated links: all there", missing_links(entity, rel, links)))
    return out.select("name", F.col("violations").cast("long").alias("violations"), (F.col("violations") == 0).alias("ok"))


def coverage(entity: DataFrame, rel: DataFrame) -> DataFrame:
    """(metric, n, percent) over all methods: one row per property, percentages rounded half to even."""
    from_ids = lambda *kinds: of_kind(rel, *kinds).select(F.col("from_id").alias("id"))
    edge = lambda kind, a, b: of_kind(rel, kind).select(F.col("from_id").alias(a), F.col("to_id").alias(b))
    requires = edge("REQUIRES_ASSUMPTION", "stat", "assumption")
    checked = members(requires, "assumption", edge("CHECKED_BY", "id", "d"))
    uses, performs, amenable = edge("USES_STATISTICAL_METHOD", "id", "stat"), edge("PERFORMS", "id", "op"), edge("AMENABLE_TO", "op", "stat")
    semi = lambda x, y, c: x.join(y.select(c).distinct(), c, "left_semi")
    via_operation = semi(performs, semi(amenable, checked, "stat"), "op").select("id")
    sets = {
        "with_operation": from_ids("PERFORMS"),
        "with_container": from_ids("PACKAGED_AS"),
        "with_io_contract": from_ids("INPUT", "OUTPUT"),
        "with_statistical_method": from_ids("USES_STATISTICAL_METHOD"),
        "with_inherited_assumption": semi(uses, requires, "stat").select("id"),
        "with_checked_assumption": semi(uses, checked, "stat").select("id").union(via_operation),
        "with_checked_via_operation": via_operation,
        "with_any_statistical_path": uses.select("id").union(semi(performs, amenable, "op").select("id")),
    }
    methods = of_kind(entity, "Method")
    flags = methods.select("id", (F.col("biotools_id") != "").alias("with_biotools_id"), (F.col("bioconda_pkg") != "").alias("with_bioconda_pkg"))
    every = None
    for name, ids in sets.items():
        x = ids.distinct().select("id", F.lit(name).alias("metric"))
        every = x if every is None else every.unionByName(x)
    own = flags.select("id", F.explode(F.array(*(F.when(F.col(c), F.lit(c)) for c in ("with_biotools_id", "with_bioconda_pkg")))).alias("metric")).where("metric is not null")
    # a metric that no method has still gets its row
    names = entity.sparkSession.createDataFrame([(n,) for n in [*sets, "with_biotools_id", "with_bioconda_pkg", "methods"]], "metric string")
    counts = members(every, "id", methods).unionByName(own).unionByName(methods.select("id", F.lit("methods").alias("metric"))).groupBy("metric").agg(F.count("*").alias("n"))
    total = methods.agg(F.count("*").alias("total"))
    out = names.join(counts, "metric", "left").select("metric", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(total))
    return out.select("metric", "n", percent(F.col("n"), F.col("total")).alias("percent"))


def percent(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(100 * n / total, 1)).otherwise(0.0)


def same_as_basis(rel: DataFrame) -> DataFrame:
    basis = F.coalesce(F.get_json_object("properties", "$.basis"), F.lit("unknown"))
    return of_kind(rel, "SAME_AS").groupBy(basis.alias("basis")).agg(F.count("*").alias("n"))


def skill_coverage(entity: DataFrame, rel: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(skill_id, n_wired, n_evaluable, gap): how many methods a skill wraps and how many of them have a verdict."""
    skills = of_kind(entity, "Skill").select(F.col("id").alias("skill_id"))
    wraps = members(of_kind(rel, "WRAPS"), "from_id", of_kind(entity, "Skill")).select(F.col("from_id").alias("skill_id"), F.col("to_id").alias("method_id")).distinct()
    x = wraps.join(verdicts.select("method_id", "status"), "method_id", "left")
    n = x.groupBy("skill_id").agg(F.count("*").alias("n_wired"), F.count_if(F.coalesce("status", F.lit("NOT_EVALUABLE")) != "NOT_EVALUABLE").alias("n_evaluable"))
    out = skills.join(n, "skill_id", "left").na.fill(0)
    return out.withColumn("gap", F.when(F.col("n_wired") == 0, "unwired").when(F.col("n_evaluable") == 0, "not evaluable").otherwise(""))


def reconciliation(entity: DataFrame, source_counts: DataFrame) -> DataFrame:
    """(kind, n_source, n_graph, ok) of source counts (kind, n) against the graph."""
    have = entity.groupBy("kind").agg(F.count("*").alias("n_graph"))
    x = source_counts.select("kind", F.col("n").alias("n_source")).join(have, "kind", "left").na.fill(0)
    return x.select("kind", "n_source", "n_graph", (F.col("n_source") == F.col("n_graph")).alias("ok"))


def metric_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after) of the metrics that changed, appeared or went, of two (metric, value) tables."""
    a, b = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return a.join(b, "metric", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def over_merged(records: DataFrame) -> DataFrame:
    """(id, names, absorbed) of ids that hold more than one name, letter case apart."""
    x = records.groupBy("id").agg(F.array_sort(F.collect_set(F.lower("name"))).alias("names")).where(F.size("names") > 1)
    return x.select("id", F.array_join("names", "|").alias("names"), (F.size("names") - 1).cast("long").alias("absorbed"))
