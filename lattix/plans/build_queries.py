"""Registered queries of the resolution, audit, planning and scoring operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattix.operators import audit as A
from lattix.operators import contract as K
from lattix.operators import evalkit as E
from lattix.operators import planner as P
from lattix.operators import resolve as R
from lattix.operators import traverse as T
from lattix.operators import verdict as V
from lattix.plans.bridge import entities, graph, relations, sql, sql_with, star
from lattix.plans.graph_queries import CONTRACT, contract_graph, facts, ids
from lattix.plans.runtime import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def text(column: str):
    return F.col(column).cast("string")


# ---- resolution


def part_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records of one id per brand and size, with gaps in some columns."""
    p = star(spark, d, "part")
    return p.select(
        F.concat("p_brand", F.lit("/"), text("p_size")).alias("id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise("").alias("bioconda_pkg"),
        F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("type"), F.col("p_type"))).otherwise(F.create_map(F.lit("key"), text("p_partkey"))).alias("props"),
        F.col("p_partkey").alias("src_ord"),
    )


_RECORDS = """r0 as (select p_brand || '/' || cast(p_size as varchar) as id, p_name as name, case when p_partkey % 3 = 0 then p_type else '' end as pkg,
    case when p_partkey % 2 = 0 then p_type end as t, case when p_partkey % 2 <> 0 then cast(p_partkey as varchar) end as k, p_partkey as src_ord from part),
  r as (select *, row_number() over (partition by id order by case when t is not null then '{"type":"' || t || '"}' else '{"key":"' || k || '"}' end, src_ord) as rank from r0)"""


@register(
    "r1_hard_merge",
    f"""with {_RECORDS} select id, count(*) as n_records, arg_min(name, rank) as name, coalesce(arg_min(pkg, rank) filter (pkg <> ''), '') as bioconda_pkg,
    coalesce(arg_min(t, rank) filter (t is not null), '') as prop_type, coalesce(arg_min(k, rank) filter (k is not null), '') as prop_key from r group by id""",
)
def _(spark, d):
    m = R.hard_merge(part_records(spark, d))
    prop = lambda k: F.coalesce(F.try_element_at("props", F.lit(k)), F.lit("")).alias(f"prop_{k}")
    return m.select("id", "n_records", "name", "bioconda_pkg", prop("type"), prop("key"))


_METHODS = "m as (select 'm:' || cast(p_partkey as varchar) as id, lower(p_name) as name, lower(p_name || '/' || p_brand) as reg from part)"


@register(
    "r2_same_as_candidates",
    f"""with {_METHODS}, g as (select reg from m group by 1 having count(*) between 2 and 8), h as (select name from m group by 1 having count(*) between 2 and 8),
    p as (select a.id as from_id, b.id as to_id, 0.7::double as confidence, 'biotools_id' as basis from m a join m b on a.reg = b.reg and a.id < b.id where a.reg in (select reg from g)
      union all select a.id, b.id, 0.5::double, 'name' from m a join m b on a.name = b.name and a.id < b.id where a.name in (select name from h))
    select from_id, to_id, max(confidence) as confidence, arg_max(basis, confidence) as basis from p group by 1, 2""",
)
def _(spark, d):
    return R.same_as(entities(spark, d, "Method"))


@register("r5_large_groups", f"with {_METHODS} select reg as key, count(*) as n from m group by 1 having count(*) > 8")
def _(spark, d):
    return R.large_groups(entities(spark, d, "Method"), F.col("biotools_id"))


@register(
    "r6_first_wins_dedupe",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice) as n from lineitem) x where n = 1""",
)
def _(spark, d):
    line = star(spark, d, "lineitem").withColumn("src_ord", F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    return R.first_wins(line, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("r7_first_node", "select p_brand, min(p_partkey) as p_partkey from part group by 1")
def _(spark, d):
    return R.first_wins(star(spark, d, "part").withColumn("src_ord", F.col("p_partkey")), "p_brand").select("p_brand", "p_partkey")


@register(
    "r8_packaged_as",
    sql("""select distinct m.id as from_id, coalesce(c.from_id, p.id) as to_id from entity m join entity p on p.kind = 'Package' and lower(p.name) = lower(m.bioconda_pkg)
    left join (select from_id, to_id from rel where kind = 'FROM_PACKAGE' and from_id like '%00') c on c.to_id = p.id where m.kind = 'Method'"""),
)
def _(spark, d):
    entity, rel = graph(spark, d, nodes=["Package", "Method"], edges=["FROM_PACKAGE"])
    return R.packaged_as(entity, rel.where("kind = 'FROM_PACKAGE'").where(F.col("from_id").endswith("00")))


def transitions(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, a, b): consecutive kinds of a user's events."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = star(spark, d, "events").select("user_id", F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), "event_id")
    return x.where("b is not null and a <> b")


_TRANS = "tr as (select user_id, event_id, event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events), t as (select * from tr where b is not null and a <> b)"


@register(
    "r9_attestation_merge",
    f"""with {_TRANS} select a as from_id, b as to_id, count(distinct user_id) as attestations, max(case when user_id % 2 = 0 then 0.95 else 0.5 end)::double as confidence,
    arg_min(case when user_id % 2 = 0 then 'nextflow_dsl2' else 'io_inferred' end, event_id) as derivation, min(cast(user_id as varchar)) as first_pipeline from t group by 1, 2""",
)
def _(spark, d):
    even = F.col("user_id") % 2 == 0
    x = transitions(spark, d).select(
        F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.array(text("user_id")).alias("pipelines"), F.when(even, 0.95).otherwise(0.5).alias("confidence"),
        F.when(even, "nextflow_dsl2").otherwise("io_inferred").alias("derivation"), F.col("event_id").alias("src_ord"),
    )
    return R.merge_attestations(x).withColumn("first_pipeline", F.get("pipelines", F.lit(0))).drop("pipelines")


@register(
    "j10_ground_links",
    sql("""select l.from_id, l.to_id, case when a.id is null then 'from_missing' when a.kind <> 'Method' then 'from_wrong_kind:' || a.kind when b.id is null then 'to_missing'
      when b.kind <> 'StatisticalMethod' then 'to_wrong_kind:' || b.kind end as skipped
    from (select 'm:' || cast(l_partkey as varchar) as from_id, case when l_suppkey % 10 = 0 then 'assum:1' when l_suppkey % 10 = 1 then 'gone' else 'stat:' || cast(l_suppkey as varchar) end as to_id
          from lineitem where l_linenumber = 1 union all select 'mod:brand1', 'stat:1') l left join entity a on a.id = l.from_id left join entity b on b.id = l.to_id"""),
)
def _(spark, d):
    k = F.col("l_suppkey") % 10
    to = F.when(k == 0, "assum:1").when(k == 1, "gone").otherwise(F.concat(F.lit("stat:"), text("l_suppkey")))
    links = star(spark, d, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("m:"), text("l_partkey")).alias("from_id"), to.alias("to_id"))
    links = links.unionByName(spark.createDataFrame([("mod:brand1", "stat:1")], "from_id string, to_id string"))
    return R.ground_links(links, entities(spark, d), "Method", "StatisticalMethod").select("from_id", "to_id", "skipped")


@register(
    "j11_registry_edges",
    sql("""select distinct m.id as from_id, o.to_id from entity m join (select lower(p_name || '/' || p_brand) as reg, unnest(['op:new', 'op:' || lower(replace(p_type, ' ', '_'))]) as to_id from part where p_size < 20) o
    on o.reg = lower(trim(m.biotools_id)) where m.kind = 'Method' and not exists (select 1 from rel r where r.kind = 'PERFORMS' and r.from_id = m.id and r.to_id = o.to_id)"""),
)
def _(spark, d):
    entity, rel = graph(spark, d, nodes=["Method"], edges=["PERFORMS"])
    op = F.concat(F.lit("op:"), F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))))
    records = star(spark, d, "part").where("p_size < 20").select(F.concat("p_name", F.lit("/"), "p_brand").alias("registry_id"), F.array(F.lit("op:new"), op).alias("operations"))
    return R.registry_edges(T.of_kind(entity, "Method"), records, T.of_kind(rel, "PERFORMS"))


@register(
    "j13_io_overlap",
    """select distinct a.l_orderkey as pipeline, a.p_brand as a, b.p_brand as b from (select l_orderkey, p_brand, (p_size + 1) % 5 as d from lineitem join part on p_partkey = l_partkey) a
    join (select l_orderkey, p_brand, p_size % 5 as d from lineitem join part on p_partkey = l_partkey) b on a.l_orderkey = b.l_orderkey and a.d = b.d and a.p_brand <> b.p_brand""",
)
def _(spark, d):
    from lattix.sources.pipelines import io_overlap

    x = star(spark, d, "lineitem").join(star(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    x = x.select(F.col("l_orderkey").alias("pipeline"), F.col("p_brand").alias("module_id"), (F.col("p_size") % 5).alias("i"), ((F.col("p_size") + 1) % 5).alias("o"))
    return io_overlap(x.select("pipeline", "module_id", F.col("o").alias("data")), x.select("pipeline", "module_id", F.col("i").alias("data")))


# ---- audit

#: The closure of edges {e}(a, b) as {n}.
_RESIDUAL = """{n}(a, b) as (select a, b from {e} union select {n}.a, {e}.b from {n} join {e} on {e}.a = {n}.b)"""

_TYPED = "typed as (select r.*, a.kind as fk, b.kind as tk from rel r left join entity a on a.id = r.from_id left join entity b on b.id = r.to_id)"


def audit_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph with a few faults: wrong ends, a self loop, a bad node."""
    entity, rel = graph(spark, d)
    bad = [("op:x", "m:1", "PERFORMS"), ("m:1", "pkg:brand-1", "PACKAGED_AS"), ("mod:brand1", "mod:brand1", "DOWNSTREAM_OF"), ("m:2", "nowhere", "INPUT")]
    more = spark.createDataFrame([(*b, "{}", "star", "", "2024-01-01") for b in bad], rel.select("from_id", "to_id", "kind", "properties", "source", "source_url", "ingested_at").schema)
    node = spark.createDataFrame([("exec:1", "exec", "ExecutionSpec", "{}", "", "", "star", "http://example.org", "2024-01-01"), ("m:1", "again", "Method", "{}", "", "", "star", "http://example.org", "2024-01-01")], entity.schema)
    return entity.unionByName(node), rel.unionByName(more)


def _ends(kind: str) -> str:
    from lattix.schema import ENDPOINTS

    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    a, b = ENDPOINTS[kind]
    return f"select '{kind}: endpoints' as name, count(*) filter (where not coalesce(fk in ({quoted(a)}) and tk in ({quoted(b)}), false)) as violations from typed where kind = '{kind}'"


def _evidence(kind: str) -> str:
    e = "lower(trim(coalesce(json_extract_string(properties, '$.evidence'), '')))"
    ok = " or ".join(f"starts_with({e}, '{p}')" for p in A.EVIDENCE[kind])
    return f"select '{kind}: grounded', count(*) filter (where not ({ok})) from typed where kind = '{kind}'"


def _checks() -> str:
    from lattix.schema import ENDPOINTS

    return " union all ".join(
        [*map(_ends, ENDPOINTS), *map(_evidence, A.EVIDENCE)]
        + [
            "select 'DOWNSTREAM_OF: no self loop', count(*) from typed where kind = 'DOWNSTREAM_OF' and from_id = to_id",
            "select 'REL: provenance', count(*) from typed where source = '' or source_url = '' or ingested_at = ''",
            "select 'ENTITY: unique id', count(*) from (select id from entity group by 1 having count(*) > 1) u",
            "select 'ENTITY: provenance', count(*) from entity where source = '' or source_url = '' or ingested_at = ''",
        ]
    )


_FAULTS = """all_entity as (select id, name, kind, properties, source, source_url, ingested_at from entity union all
    select * from (values ('exec:1', 'exec', 'ExecutionSpec', '{}', 'star', 'http://example.org', '2024-01-01'), ('m:1', 'again', 'Method', '{}', 'star', 'http://example.org', '2024-01-01')) v),
  all_rel as (select from_id, to_id, kind, properties, source, source_url, ingested_at from rel union all select from_id, to_id, kind, '{}', 'star', '', '2024-01-01'
    from (values ('op:x', 'm:1', 'PERFORMS'), ('m:1', 'pkg:brand-1', 'PACKAGED_AS'), ('mod:brand1', 'mod:brand1', 'DOWNSTREAM_OF'), ('m:2', 'nowhere', 'INPUT')) v(from_id, to_id, kind)),
  typed as (select r.*, a.kind as fk, b.kind as tk from all_rel r left join all_entity a on a.id = r.from_id left join all_entity b on b.id = r.to_id),
  flow as (select from_id as a, to_id as b from all_rel where kind = 'DOWNSTREAM_OF' and json_extract_string(properties, '$.derivation') = 'nextflow_dsl2')"""

_MORE_CHECKS = """ union all select 'DOWNSTREAM_OF: attestations', count(*) filter (where not coalesce(len(p) > 0 and list_sort(list_distinct(p)) = p and len(p) = n, false))
    from (select cast(json_extract(properties, '$.pipelines') as varchar[]) as p, cast(json_extract_string(properties, '$.attestations') as bigint) as n from typed where kind = 'DOWNSTREAM_OF') x
  union all select 'ExecutionSpec: container', count(*) from all_entity where kind = 'ExecutionSpec' and coalesce(json_extract_string(properties, '$.container'), '') = ''
  union all select 'ExecutionSpec: reached', count(*) from all_entity where kind = 'ExecutionSpec' and id not in (select to_id from all_rel where kind = 'RUNS_AS')
  union all select 'DOWNSTREAM_OF: acyclic', count(distinct b) from reach where a in (select a from reach where a = b)"""


def _invariants_sql() -> str:
    checks = _checks().replace("from entity", "from all_entity") + _MORE_CHECKS
    body = sql_with(f"{_FAULTS}, {_RESIDUAL.format(n='reach', e='flow')}", f"select name, violations::bigint as violations, violations = 0 as ok from ({checks}) x(name, violations)")
    return body.replace("with entity as", "with recursive entity as", 1)


@register("audit_invariants", _invariants_sql())
def _(spark, d):
    return A.invariants(*audit_graph(spark, d))


@register("audit_typed_checks", sql_with(_TYPED, f"select name, violations, violations = 0 as ok from ({_checks()}) x(name, violations)"))
def _(spark, d):
    entity, rel = entities(spark, d), relations(spark, d)
    some = F.col("name").endswith(": endpoints") | F.col("name").endswith(": grounded") | F.col("name").isin("DOWNSTREAM_OF: no self loop", "REL: provenance", "ENTITY: unique id", "ENTITY: provenance")
    return A.invariants(entity, rel).where(some)


_CHAIN = """req as (select from_id as stat, to_id as a from rel where kind = 'REQUIRES_ASSUMPTION'), chk as (select stat from req where a in (select from_id from rel where kind = 'CHECKED_BY')),
  uses as (select from_id as id, to_id as stat from rel where kind = 'USES_STATISTICAL_METHOD'), perf as (select from_id as id, to_id as op from rel where kind = 'PERFORMS'), amen as (select from_id as op, to_id as stat from rel where kind = 'AMENABLE_TO'),
  viaop as (select id from perf where op in (select op from amen where stat in (select stat from chk))),
  sets(metric, id) as (
    select 'with_operation', id from perf union select 'with_container', from_id from rel where kind = 'PACKAGED_AS' union select 'with_io_contract', from_id from rel where kind in ('INPUT', 'OUTPUT')
    union select 'with_statistical_method', id from uses union select 'with_inherited_assumption', id from uses where stat in (select stat from req)
    union select 'with_checked_assumption', id from uses where stat in (select stat from chk) union select 'with_checked_assumption', id from viaop union select 'with_checked_via_operation', id from viaop
    union select 'with_any_statistical_path', id from uses union select 'with_any_statistical_path', id from perf where op in (select op from amen)
    union select 'with_biotools_id', id from entity where kind = 'Method' and biotools_id <> '' union select 'with_bioconda_pkg', id from entity where kind = 'Method' and bioconda_pkg <> ''
    union select 'methods', id from entity where kind = 'Method'),
  n as (select metric, count(*) as n from sets where id in (select id from entity where kind = 'Method') group by 1), t as (select count(*) as total from entity where kind = 'Method')"""


@register("audit_coverage", sql_with(_CHAIN, "select metric, n, round_even(100.0::double * n / total, 1) as percent from n, t"))
def _(spark, d):
    return A.coverage(*graph(spark, d, nodes=["Method"], edges=[*T.BUCKETS.values(), "REQUIRES_ASSUMPTION", "CHECKED_BY", "AMENABLE_TO"]))


@register(
    "a5_same_as_basis",
    f"""with {_METHODS}, g as (select reg from m group by 1 having count(*) between 2 and 8), p as (select case when a.id like '%1' then 'unknown' else 'biotools_id' end as basis from m a join m b on a.reg = b.reg and a.id < b.id where a.reg in (select reg from g))
    select basis, count(*) as n from p group by 1""",
)
def _(spark, d):
    p = R.pairs_sharing(entities(spark, d, "Method"), F.col("biotools_id"), 0.7, "biotools_id")
    props = F.when(F.col("from_id").endswith("1"), "{}").otherwise(F.concat(F.lit('{"basis": "'), "basis", F.lit('"}')))
    return A.same_as_basis(p.select("from_id", "to_id", F.lit("SAME_AS").alias("kind"), props.alias("properties")))


@register("a6_attestation_check", f"with {_TRANS}, g as (select a, b, count(distinct user_id) as n from t group by 1, 2) select a, b, n, n % 2 = 0 as ok from g")
def _(spark, d):
    g = transitions(spark, d).groupBy("a", "b").agg(F.array_sort(F.collect_set(text("user_id"))).alias("p"), F.count_distinct("user_id").alias("n"))
    props = F.to_json(F.struct(F.col("p").alias("pipelines"), (F.col("n") + F.col("n") % 2).alias("attestations")))
    return g.select("a", "b", "n", A.attested(props).alias("ok"))


@register("a7_smallest_arm", "select min(n) as smallest_arm, count(*) as n_arms from (select c_mktsegment, count(*) as n from customer group by 1) x")
def _(spark, d):
    from lattix.functions.facts import smallest_arm

    return smallest_arm(star(spark, d, "customer"), "c_mktsegment")


@register("a8_fingerprint", sql("select sha256(string_agg(line, chr(10) order by line)) as digest, count(*) as n from (select id || '|' || name || '|' || kind || '|' || properties || '|' || bioconda_pkg || '|' || biotools_id as line from entity) x"))
def _(spark, d):
    from lattix.operators.fingerprint import lines_of_entities, ordered_digest

    return ordered_digest(lines_of_entities(entities(spark, d)))


_LINES = """el as (select id || '|' || name || '|' || kind || '|' || properties || '|' || bioconda_pkg || '|' || biotools_id as line from entity),
  rl as (select from_id || '|' || to_id || '|' || kind || '|' || properties as line from rel)"""


@register(
    "a8_graph_fingerprint",
    sql_with(_LINES, "select 'sha256:' || sha256((select string_agg(line, chr(10) order by line) from el) || chr(10) || '==EDGES==' || chr(10) || (select string_agg(line, chr(10) order by line) from rl)) as fingerprint"),
)
def _(spark, d):
    from lattix.operators.fingerprint import graph_fingerprint

    return graph_fingerprint(entities(spark, d), relations(spark, d))


@register(
    "a14_skill_coverage",
    sql_with(
        CONTRACT,
        """select e.id as skill_id, count(distinct w.to_id) as n_wired, count(distinct case when v.status <> 'NOT_EVALUABLE' then w.to_id end) as n_evaluable,
    case when count(w.to_id) = 0 then 'unwired' when count(case when v.status <> 'NOT_EVALUABLE' then 1 end) = 0 then 'not evaluable' else '' end as gap
    from entity e left join (select * from rel where kind = 'WRAPS') w on w.from_id = e.id left join verdict v on v.method_id = w.to_id where e.kind = 'Skill' group by 1""",
    ),
)
def _(spark, d):
    entity, rel = contract_graph(spark, d, nodes=["Method", "Skill"], edges=["WRAPS"])
    wrapped = T.members(T.of_kind(rel, "WRAPS"), "from_id", T.of_kind(entity, "Skill")).select(F.col("to_id").alias("method_id")).distinct()
    gates = V.gates(K.contracts(entity, rel, wrapped), facts(spark, d))
    methods = T.of_kind(entity, "Method").select(F.col("id").alias("method_id")).join(wrapped, "method_id", "left_semi")
    return A.skill_coverage(entity, rel, V.verdicts(methods, gates))


@register(
    "a16_metric_diff",
    """with a as (select c_mktsegment as metric, count(*) as v from customer where c_custkey % 2 = 0 group by 1), b as (select c_mktsegment as metric, count(*) as v from customer where c_acctbal > 0 group by 1)
    select coalesce(a.metric, b.metric) as metric, a.v as before, b.v as after from a full join b on a.metric = b.metric where a.v is distinct from b.v""",
)
def _(spark, d):
    c = star(spark, d, "customer")
    n = lambda x: x.groupBy(F.col("c_mktsegment").alias("metric")).agg(F.count("*").alias("value"))
    return A.metric_diff(n(c.where("c_custkey % 2 = 0")), n(c.where("c_acctbal > 0")))


@register("d19_reconciliation", sql("select kind, n_source, n_graph, n_source = n_graph as ok from (select 'Method' as kind, (select count(*) from part) as n_source union all select 'Pipeline', (select count(*) - 1 from orders)) s join (select kind, count(*) as n_graph from entity group by 1) g using (kind)"))
def _(spark, d):
    n = lambda t, k, less=0: star(spark, d, t).agg((F.count("*") - less).alias("n")).select(F.lit(k).alias("kind"), "n")
    return A.reconciliation(entities(spark, d), n("part", "Method").unionByName(n("orders", "Pipeline", 1)))


@register("d22_over_merge", "select p_brand || '/' || cast(p_size as varchar) as id, string_agg(distinct lower(p_name), '|' order by lower(p_name)) as names, count(distinct lower(p_name)) - 1 as absorbed from part group by 1 having count(distinct lower(p_name)) > 1")
def _(spark, d):
    return A.over_merged(part_records(spark, d))


@register(
    "g4_cycle_residual",
    f"""with recursive {_TRANS}, e as (select a, b from t group by 1, 2 having count(distinct user_id) > 5), {_RESIDUAL.format(n="reach", e="e")}
    select distinct b as id from reach where a in (select a from reach where a = b)""",
)
def _(spark, d):
    t = transitions(spark, d).groupBy("a", "b").agg(F.count_distinct("user_id").alias("n"))
    return A.cycle_residual(t.where("n > 5").select("a", "b"))


@register(
    "g5_root_classification",
    """with recursive edge(child, parent) as (select 'nation:' || cast(n_nationkey as varchar), 'region:' || cast(n_regionkey as varchar) from nation union all select 'supp:' || cast(s_suppkey as varchar), 'nation:' || cast(s_nationkey as varchar) from supplier),
    walk(id, root) as (select x, x from (values ('region:0'), ('region:1'), ('nation:7')) r(x) union select child, root from edge join walk on parent = walk.id)
    select id, min(root) as root from walk group by id""",
)
def _(spark, d):
    from lattix.sources.owl import classify

    n, s = star(spark, d, "nation"), star(spark, d, "supplier")
    key = lambda k, c: F.concat(F.lit(f"{k}:"), text(c))
    edges = n.select(key("nation", "n_nationkey").alias("child"), key("region", "n_regionkey").alias("parent"))
    edges = edges.unionByName(s.select(key("supp", "s_suppkey").alias("child"), key("nation", "s_nationkey").alias("parent")))
    return classify(edges, ids(spark, "region:0", "region:1", "nation:7"))


# ---- planner and validator

_SUGGEST = """fr as (select * from (values ('mod:brand1'), ('data:2')) v(id)),
  cont as (select to_id as module_id, n, from_id as via, 'downstream' as why, row_number() over (partition by to_id order by n desc, from_id) as k
    from (select from_id, to_id, cast(json_extract_string(properties, '$.attestations') as bigint) as n from rel where kind = 'DOWNSTREAM_OF' and from_id in (select id from fr)) x),
  entr as (select w.from_id as module_id, (select count(distinct h.from_id) from rel h where h.kind = 'HAS_MODULE' and h.to_id = w.from_id) as n, min(i.to_id) as via, 'entry' as why
    from rel w join rel i on i.kind = 'INPUT' and i.from_id = w.to_id and i.to_id in (select id from fr) where w.kind = 'WRAPS' and w.from_id in (select id from entity where kind = 'Module') group by 1),
  every as (select module_id, n, via, why from cont where k = 1 union all select module_id, n, via, why from entr),
  best as (select * from every where module_id not in (select id from fr) and module_id <> 'mod:brand3' qualify row_number() over (partition by module_id order by n desc, why) = 1),
  ex as (select w.from_id as module_id, min(w.to_id) as method_id, count(distinct w.to_id) - 1 as alternatives from rel w join entity m on m.id = w.to_id and m.kind = 'Method' where w.kind = 'WRAPS' group by 1),
  img as (select p.from_id as method_id, arg_min(coalesce(nullif(json_extract_string(c.properties, '$.image_name'), ''), c.name), c.id) as container from rel p join entity c on c.id = p.to_id and c.kind = 'Container' where p.kind = 'PACKAGED_AS' group by 1),
  top as (select b.module_id, b.n, ex.method_id, alternatives, container, why, via from best b join ex using (module_id) left join img using (method_id) order by n desc, module_id limit 10)"""


@register(
    "d8_next_step_suggestions",
    sql_with(
        _SUGGEST,
        """select row_number() over (order by n desc, module_id)::int as ord, module_id, n as count, method_id, alternatives, container,
    case when why = 'downstream' then 'follows ' || via || ' in ' || cast(n as varchar) || ' pipelines' else 'reads ' || via || ', in ' || cast(n as varchar) || ' pipelines' end as why from top""",
    ),
)
def _(spark, d):
    entity, rel = graph(spark, d, nodes=["Module", "Method", "Container"], edges=["DOWNSTREAM_OF", "INPUT", "WRAPS", "HAS_MODULE", "PACKAGED_AS"])
    return P.suggest(entity, rel, ids(spark, "mod:brand1", "data:2"), exclude=ids(spark, "mod:brand3"))


def workflows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as workflows: a line is a step, its artifacts are numbered by line."""
    line = star(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = line.join(star(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).withColumn("step_ord", F.row_number().over(w))
    line = cut(line.select("l_orderkey", "step_ord", "l_partkey", "l_suppkey", "p_size"))  # steps, artifacts and decisions are made of it
    c = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    n, size = F.col("step_ord"), F.col("p_size")
    steps = line.select(
        c("wf:", F.col("l_orderkey")).alias("workflow"), "step_ord", c("s", n).alias("step_id"),
        F.when(F.col("l_suppkey") % 11 == 0, "m:gone").otherwise(c("m:", F.col("l_partkey"))).alias("method_id"),
        F.when(F.col("l_suppkey") % 3 == 0, c("ctr:", F.col("l_partkey"))).otherwise("").alias("container"),
        F.array(c("a", n - 1)).alias("inputs"), F.array(c("a", n), F.lit("a1")).alias("outputs"), F.array(c("data:", size % 5)).alias("evidence"),
    )
    artifacts = line.where("l_suppkey % 4 <> 0").select(c("wf:", F.col("l_orderkey")).alias("workflow"), c("a", n).alias("artifact_id"), F.when(size % 2 == 0, c("data:", size % 5)).otherwise("").alias("format"), c("s", n).alias("produced_by"))
    decisions = line.where("step_ord = 1").select(c("wf:", F.col("l_orderkey")).alias("workflow"), F.lit("d1").alias("decision_id"), F.array(F.lit("a1"), F.lit("a99")).alias("inputs"), F.array(F.lit("s2"), F.lit("")).alias("leads_to"))
    return steps, artifacts, decisions


_WORKFLOW = """ln as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::int as step_ord from lineitem join part on p_partkey = l_partkey),
  st as (select 'wf:' || l_orderkey as workflow, step_ord, 's' || step_ord as step_id, case when l_suppkey % 11 = 0 then 'm:gone' else 'm:' || l_partkey end as method_id,
    case when l_suppkey % 3 = 0 then 'ctr:' || l_partkey else '' end as container, ['a' || (step_ord - 1)] as inputs, ['a' || step_ord, 'a1'] as outputs, 'data:' || (p_size % 5) as item_ev from ln),
  art as (select 'wf:' || l_orderkey as workflow, 'a' || step_ord as item, case when p_size % 2 = 0 then 'data:' || (p_size % 5) else '' end as format, 's' || step_ord as produced_by from ln where l_suppkey % 4 <> 0),
  fd as (select * from st where method_id in (select id from entity where kind = 'Method')),
  inn as (select workflow, step_ord, step_id, method_id, unnest(inputs) as item from fd), outn as (select workflow, step_ord, step_id, method_id, unnest(outputs) as item from fd),
  io as (select from_id, to_id, kind from rel where kind in ('INPUT', 'OUTPUT')), dec as (select distinct workflow from st where step_ord = 1),
  issues(workflow, step_ord, step_id, check_ord, code, subject) as (
    select workflow, step_ord, step_id, 1, 'method_not_found', method_id from st where method_id not in (select id from entity where kind = 'Method') union all
    select workflow, step_ord, step_id, 2, 'method_not_allowed', method_id from fd where method_id like '%5' union all
    select workflow, step_ord, step_id, 3, 'container_not_packaged', container from fd where container <> '' and not exists (select 1 from rel r where r.kind = 'PACKAGED_AS' and r.from_id = fd.method_id and r.to_id = fd.container) union all
    select workflow, step_ord, step_id, 4, 'evidence_missing', item_ev from fd where not exists (select 1 from rel r where r.kind in ('PERFORMS', 'INPUT', 'OUTPUT') and r.from_id = fd.method_id and r.to_id = fd.item_ev) union all
    select workflow, step_ord, step_id, 5, 'input_artifact_unknown', item from inn where (workflow, item) not in (select workflow, item from art) union all
    select workflow, step_ord, step_id, 6, 'output_artifact_unknown', item from outn where (workflow, item) not in (select workflow, item from art) union all
    select o.workflow, o.step_ord, o.step_id, 7, 'output_not_produced_here', o.item from outn o join art a on a.workflow = o.workflow and a.item = o.item where a.produced_by is distinct from o.step_id union all
    select o.workflow, o.step_ord, o.step_id, 8, 'input_contract_violation', o.item from inn o join art a on a.workflow = o.workflow and a.item = o.item where a.format <> '' and o.method_id in (select from_id from io where kind = 'INPUT') and (o.method_id, a.format) not in (select from_id, to_id from io where kind = 'INPUT') union all
    select o.workflow, o.step_ord, o.step_id, 9, 'output_contract_violation', o.item from outn o join art a on a.workflow = o.workflow and a.item = o.item where a.format <> '' and o.method_id in (select from_id from io where kind = 'OUTPUT') and (o.method_id, a.format) not in (select from_id, to_id from io where kind = 'OUTPUT') union all
    select workflow, null, '', 10, 'decision_input_unknown', i from (select workflow, unnest(['a1', 'a99']) as i from dec) x where (workflow, i) not in (select workflow, item from art) union all
    select workflow, null, '', 11, 'decision_leads_to_unknown', i from (select workflow, unnest(['s2', '']) as i from dec) x where (workflow, i) not in (select workflow, step_id from st))"""


@register("d10_workflow_issues", sql_with(_WORKFLOW, "select workflow, step_ord, step_id, check_ord, code, subject from issues"))
def _(spark, d):
    entity, rel = graph(spark, d, nodes=["Method", "Operation", "Data"], edges=["PACKAGED_AS", "PERFORMS", "INPUT", "OUTPUT"])
    allowed = T.of_kind(entity, "Method").where(~F.col("id").endswith("5")).select("id")
    return P.validate(entity, rel, *workflows(spark, d), allowed=allowed)


@register("d9_allowed_methods", sql("select distinct b.id from rel r join entity b on b.kind = 'Method' and b.id in (r.from_id, r.to_id) where 'stat:7' in (r.from_id, r.to_id)"))
def _(spark, d):
    entity, rel = graph(spark, d)
    return P.allowed_methods(entity, rel, ids(spark, "stat:7"))


# ---- scoring


def sequences(spark: SparkSession, d: str, odd: int) -> DataFrame:
    """(item, pos, method_id): the distinct parts of every order, without every third line number, in order."""
    line = star(spark, d, "lineitem").where(f"(l_linenumber + {odd}) % 3 > 0")
    x = line.groupBy(text("l_orderkey").alias("item"), F.concat(F.lit("m:"), text("l_partkey")).alias("method_id")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("at"))
    return x.select("item", (F.row_number().over(Window.partitionBy("item").orderBy("at")) - 1).alias("pos"), "method_id")


def _seq(name: str, odd: int) -> str:
    return f"""{name} as (select item, method_id, row_number() over (partition by item order by ln, pk, sk) - 1 as pos from (
      select cast(l_orderkey as varchar) as item, 'm:' || cast(l_partkey as varchar) as method_id, arg_min(l_linenumber, r) as ln, arg_min(l_partkey, r) as pk, arg_min(l_suppkey, r) as sk
      from (select *, row_number() over (order by l_linenumber, l_partkey, l_suppkey) as r from lineitem where (l_linenumber + {odd}) % 3 > 0) y group by 1, 2) x)"""


_IO = "inp as (select from_id as method_id, to_id as data from rel where kind = 'INPUT'), outp as (select from_id as method_id, to_id as data from rel where kind = 'OUTPUT')"


_CLASSES = f"{_IO}, ops as (select from_id as method_id, to_id as op from rel where kind = 'PERFORMS' and to_id <> 'op:promo'), cl as (select distinct op, data, method_id from ops join inp using (method_id))"


def classes(spark: SparkSession, d: str) -> DataFrame:
    o = E.oracle(*graph(spark, d, nodes=["Method"], edges=["WRAPS", "PERFORMS", "INPUT", "OUTPUT"]))
    return E.equivalence_classes(o["operations"], o["inputs"], ["op:promo"])


@register("e1_equivalence_classes", sql_with(_CLASSES, "select op, data, method_id from cl"))
def _(spark, d):
    return classes(spark, d)


@register("e2_class_sizes", sql_with(_CLASSES, "select op, data, count(*) as n_methods, min(method_id) as first_method from cl group by 1, 2 having count(*) > 1"))
def _(spark, d):
    return E.class_sizes(classes(spark, d))


@register("e2_equivalents", sql_with(_CLASSES, "select distinct x.method_id as a, y.method_id as b from cl x join cl y on x.op = y.op and x.data = y.data and x.method_id <> y.method_id where x.method_id in (select min(method_id) from cl group by op, data)"))
def _(spark, d):
    c = classes(spark, d)
    return E.equivalents_of(c, c.groupBy("op", "data").agg(F.min("method_id").alias("method_id")))


@register(
    "e3_selection_f1",
    sql_with(
        f"{_seq('g', 0)}, {_seq('p', 1)}, n as (select item, count(*) as ng from g group by 1), q as (select item, count(*) as np from p group by 1), h as (select item, count(*) as nh from g join p using (item, method_id) group by 1), s as (select item, ng, coalesce(np, 0) as np, coalesce(nh, 0) as nh from n left join q using (item) left join h using (item))",
        """select item, case when np > 0 then nh / np else 0 end as precision, nh / ng as recall, case when nh > 0 then 2 * (nh / np) * (nh / ng) / (nh / np + nh / ng) else 0 end as f1 from s""",
    ),
)
def _(spark, d):
    g, p = sequences(spark, d, 0), sequences(spark, d, 1)
    return E.selection(g, p, E.identity_hits(g, p))


@register("e3_selection_matched")
def _(spark, d):
    g, p = sequences(spark, d, 0), sequences(spark, d, 1)
    o = E.oracle(*graph(spark, d, nodes=["Method"], edges=["WRAPS", "PERFORMS", "INPUT", "OUTPUT"]))
    return E.selection(g, p, E.matched_by_class(g, p, o["operations"], o["inputs"]))


@register(
    "e4_sequencing",
    sql_with(
        f"{_seq('g', 0)}, {_seq('p', 1)}, e as (select item, method_id as a, lead(method_id) over (partition by item order by pos) as b from g)",
        "select e.item, count(*) as n_edges, count(*) filter (where x.pos < y.pos) as n_kept, (count(*) filter (where x.pos < y.pos)) / count(*) as share from e join p x on x.item = e.item and x.method_id = e.a join p y on y.item = e.item and y.method_id = e.b group by 1",
    ),
)
def _(spark, d):
    g, p = sequences(spark, d, 0), sequences(spark, d, 1)
    edges = g.select("item", F.col("method_id").alias("from_id"), F.lead("method_id").over(Window.partitionBy("item").orderBy("pos")).alias("to_id")).where("to_id is not null")
    return E.sequencing(edges, p)


@register(
    "e5_validity",
    sql_with(
        f"{_seq('g', 0)}, {_IO}, net as (select * from outp except select * from inp)",
        """select item, pos::int as pos, method_id, case when exists (select 1 from inp i join outp o on o.data = i.data join g e on e.method_id = o.method_id where i.method_id = g.method_id and e.item = g.item and e.pos < g.pos) then 'VALID'
      when exists (select 1 from inp i join net o on o.data = i.data join g e on e.method_id = o.method_id where i.method_id = g.method_id and e.item = g.item and e.pos > g.pos) then 'BROKEN' else 'UNKNOWN' end as state from g""",
    ),
)
def _(spark, d):
    o = E.oracle(*graph(spark, d, nodes=["Method"], edges=["WRAPS", "PERFORMS", "INPUT", "OUTPUT"]))
    return E.validity(sequences(spark, d, 0), o["inputs"], o["outputs"])


def next_answers(spark: SparkSession, d: str) -> DataFrame:
    """(item, pos, gold, ranked): every event of a user with the three kinds before it as the ranked answer."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    lag = lambda k: F.coalesce(F.lag("event_type", k).over(w), F.lit("none"))
    return star(spark, d, "events").select(text("user_id").alias("item"), (F.row_number().over(w) - 1).alias("pos"), F.col("event_type").alias("gold"), F.array(lag(1), lag(2), lag(3)).alias("ranked"))


_NEXT = """a as (select user_id, event_type as gold, row_number() over w - 1 as pos, coalesce(lag(event_type, 1) over w, 'none') as r1, coalesce(lag(event_type, 2) over w, 'none') as r2, coalesce(lag(event_type, 3) over w, 'none') as r3
    from events window w as (partition by user_id order by ts, event_id)),
  h as (select user_id, pos, gold, case when pos = 0 then '0' when pos <= 2 then '1-2' when pos <= 5 then '3-5' else '6+' end as bucket, gold = r1 as top1, list_contains([r1, r2, r3], gold) as topk from a)"""


@register("w8_topk_hit", f"with {_NEXT} select cast(user_id as varchar) as item, pos::int as pos, gold, bucket, top1, topk from h")
def _(spark, d):
    return E.next_step_hits(next_answers(spark, d)).drop("ranked")


@register("a9_bucket_accuracy", f"with {_NEXT} select bucket, count(*) as n, avg(top1::int::double) as top1, avg(topk::int::double) as topk from h group by 1")
def _(spark, d):
    return E.next_step_by_bucket(E.next_step_hits(next_answers(spark, d)))


@register(
    "a9_headline",
    f"""with {_NEXT}, m as (select bucket, avg(top1::int::double) as top1, avg(topk::int::double) as topk from h where bucket <> '0' group by 1)
    select (select avg(top1) from m) as macro_top1, (select avg(topk) from m) as macro_topk, count(*) as n, avg(top1::int::double) as pooled_top1 from h""",
)
def _(spark, d):
    return E.next_step_headline(E.next_step_hits(next_answers(spark, d)))


@register(
    "a10_run_summary",
    """with r as (select case when event_type = 'error' then 'failed' end as error, case when user_id % 7 = 0 then null when user_id % 5 = 0 then [] else ['x'] end as answer, user_id % 11 <> 0 as ok, case when event_id % 2 = 0 then 'whole' else 'next' end as task from events)
    select count(*) as n_rows, count(*) filter (error is not null) as n_errors, count(*) filter (error is null and answer is null) as n_unparsed, count(*) filter (error is null and len(answer) = 0) as n_empty,
      count(*) filter (error is null and not ok) as n_gold_unresolved, count(*) filter (error is null and ok and task = 'whole') as n_whole, count(*) filter (error is null and ok and task = 'next') as n_next from r""",
)
def _(spark, d):
    u = F.col("user_id")
    r = star(spark, d, "events").select(
        F.when(F.col("event_type") == "error", "failed").alias("error"),
        F.when(u % 7 == 0, None).when(u % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("answer"),
        (u % 11 != 0).alias("gold_resolved"), F.when(F.col("event_id") % 2 == 0, "whole").otherwise("next").alias("task"), F.col("value").alias("score"),
    )
    return E.run_summary(r).drop("mean_score")


_PREFIX = "s as (select user_id, list(event_type order by ts, event_id)[1:3] as seq from events group by 1)"


@register("a11_modal_sequence", f"with {_PREFIX} select array_to_string(seq, '>') as seq, count(*) as n from s group by 1 order by n desc, seq limit 1")
def _(spark, d):
    return E.modal_sequence(_prefixes(spark, d)).select(F.array_join("seq", ">").alias("seq"), "n")


def _prefixes(spark: SparkSession, d: str) -> DataFrame:
    seq = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return star(spark, d, "events").groupBy("user_id").agg(F.slice(seq, 1, 3).alias("seq"))


@register("a12_typical_length", "with s as (select l_orderkey, count(*) as n from lineitem group by 1) select greatest(1, round_even(avg(n), 0))::int as length from s")
def _(spark, d):
    return E.typical_length(star(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("seq")))


@register(
    "a13_oracle_coverage",
    sql_with(
        "md as (select from_id as step, min(to_id) as method_id, count(distinct to_id) as k from rel where kind = 'WRAPS' and from_id like 'mod:%' group by 1), st as (select distinct 'mod:' || lower(replace(p_brand, '#', '')) as step from part union select 'mod:gone'), j as (select * from st left join md using (step))",
        """select count(*) as n_steps, count(method_id) as n_resolved, count(*) filter (k > 1) as n_multi_wrapped, count(distinct case when method_id in (select from_id from rel where kind = 'PERFORMS') then method_id end) as with_operations,
    count(distinct case when method_id in (select from_id from rel where kind = 'INPUT') then method_id end) as with_inputs, count(distinct case when method_id in (select from_id from rel where kind = 'OUTPUT') then method_id end) as with_outputs from j""",
    ),
)
def _(spark, d):
    entity, rel = graph(spark, d, nodes=["Method", "Module"], edges=["WRAPS", "PERFORMS", "INPUT", "OUTPUT"])
    steps = T.of_kind(entity, "Module").select(F.col("id").alias("step")).unionByName(spark.createDataFrame([("mod:gone",)], "step string"))
    return E.oracle_coverage(E.oracle(entity, rel), steps)


@register("j15_oracle_modules", sql("select from_id as step, min(to_id) as method_id, count(distinct to_id) as n_methods from rel where kind = 'WRAPS' and from_id like 'mod:%' group by 1"))
def _(spark, d):
    return E.oracle(*graph(spark, d, nodes=["Method"], edges=["WRAPS", "PERFORMS", "INPUT", "OUTPUT"]))["modules"]


def charts(spark: SparkSession, d: str) -> DataFrame:
    """Users' event kinds as flow charts, one node per event."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = star(spark, d, "events").select("user_id", "event_type", F.row_number().over(w).alias("n"))
    line = F.when(F.col("n") > 1, F.format_string("v%d([%s])\nv%d --> v%d\n", "n", "event_type", F.col("n") - 1, "n")).otherwise(F.format_string("v%d([%s])\n", "n", "event_type"))
    x = x.select("user_id", F.struct("n", line.alias("line")).alias("s")).groupBy(text("user_id").alias("item")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return x.select("item", F.concat(F.lit("flowchart TB\n"), F.array_join(F.col("s.line"), "")).alias("text"))


@register("e7_gold_sequence")
def _(spark, d):
    return E.gold_orders(charts(spark, d))


@register("g2_break_cycles")
def _(spark, d):
    x = transitions(spark, d).groupBy(text("user_id").alias("grp"), "a", "b").agg(F.min("event_id").alias("rank"))
    return E.break_cycles(x)


@register("e8_projection")
def _(spark, d):
    modules = spark.createDataFrame([("click", "m:c"), ("view", "m:v"), ("purchase", "m:p"), ("signup", "m:v")], "step string, method_id string")
    return E.project_sequence(E.gold_orders(charts(spark, d)), modules)


@register("e9_prefix_items", f"""with {_seq('g', 0)} select item, pos::int as pos, array_to_string(list(method_id) over (partition by item order by pos rows between unbounded preceding and 1 preceding), '|') as given, method_id as gold from g qualify pos > 0""")
def _(spark, d):
    return E.prefix_items(sequences(spark, d, 0)).withColumn("given", F.array_join("given", "|"))


@register(
    "e15_name_resolution",
    """with n as (select cast(p_partkey as varchar) as item, p_name as name from part), k as (select distinct lower(replace(p_name, ' ', '-')) as c from part where p_size % 2 = 0)
    select item, 0 as pos, name, case when lower(replace(name, ' ', '-')) in (select c from k) then 'm:' || lower(replace(name, ' ', '-')) end as method_id from n""",
)
def _(spark, d):
    p = star(spark, d, "part")
    hyphened = F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))
    methods = p.where("p_size % 2 = 0").select(F.concat(F.lit("m:"), hyphened).alias("id")).distinct()
    return E.resolve_names(p.select(text("p_partkey").alias("item"), F.lit(0).alias("pos"), F.col("p_name").alias("name")), methods)


@register("x_parse_answer")
def _(spark, d):
    from lattix.functions.text import parse_answer

    c = star(spark, d, "conversations")
    said = F.concat("text", F.lit(" I would use "), F.to_json(F.split("text", " ")), F.lit(" [and more"))
    return c.select("conv_id", "turn", F.array_join(parse_answer(said), "|").alias("names"))


# ---- window idioms


@register("w3_consecutive_pairs", f"with {_TRANS} select a, b, count(*) as n, count(distinct user_id) as n_users from t group by 1, 2")
def _(spark, d):
    return transitions(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"))


@register("w6_min_rank", f"with {_TRANS} select a, b, min(event_id) as rank from t group by 1, 2")
def _(spark, d):
    return transitions(spark, d).groupBy("a", "b").agg(F.min("event_id").alias("rank"))


@register("w7_topk_skip", "select s_suppkey, n from (select l_suppkey as s_suppkey, count(*) as n from lineitem group by 1) x where s_suppkey in (select s_suppkey from supplier where s_acctbal > 0) order by n desc, s_suppkey limit 10")
def _(spark, d):
    n = star(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return n.join(star(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"), "s_suppkey").orderBy(F.desc("n"), "s_suppkey").limit(10)


@register("w9_pairs", "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey")
def _(spark, d):
    n = star(spark, d, "nation")
    x, y = n.select("n_regionkey", F.col("n_nationkey").alias("a")), n.select("n_regionkey", F.col("n_nationkey").alias("b"))
    return x.join(y, "n_regionkey").where("a < b").select("a", "b")


@register("w10_set_difference", "select distinct l_partkey from lineitem where l_returnflag = 'R' except select l_partkey from lineitem where l_returnflag = 'A' and l_quantity > 40")
def _(spark, d):
    line = star(spark, d, "lineitem")
    gone = line.where("l_returnflag = 'A' and l_quantity > 40").select("l_partkey").distinct()
    return line.where("l_returnflag = 'R'").select("l_partkey").distinct().join(gone, "l_partkey", "left_anti")


# ---- sinks


_CLEAN = "regexp_replace(case when {0} = 'None' then '' else {0} end, '[\t\n\r]', ' ', 'g')"


@register("s26_kgx_nodes", sql(f"select id, {_CLEAN.format('name')} as name, kind as category, source, source_url, ingested_at from entity where kind <> 'Pipeline'"))
def _(spark, d):
    from lattix.sources.kgx import kgx_nodes

    return kgx_nodes(entities(spark, d).where("kind <> 'Pipeline'"))


@register("s26_kgx_edges", sql("select from_id as subject, kind as predicate, to_id as object, source, source_url, ingested_at from rel where kind <> 'HAS_MODULE'"))
def _(spark, d):
    from lattix.sources.kgx import kgx_edges

    return kgx_edges(relations(spark, d).where("kind <> 'HAS_MODULE'"))
