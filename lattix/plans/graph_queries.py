"""Registered queries of the traversal, contract and verdict operators, over the star-schema graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.operators import contract as K
from lattix.operators import traverse as T
from lattix.operators import verdict as V
from lattix.plans.bridge import entities, graph, relations, sql, sql_with, star
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


def ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "id string")


@register("s_entity_scan", sql("select kind, count(*) as n, count(distinct id) as n_ids, min(id) as first_id from entity group by kind"))
def _(spark, d):
    return entities(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.min("id").alias("first_id"))


@register("s_rel_build", sql("select kind, count(*) as n, min(from_id) as first_from, max(to_id) as last_to from rel group by kind"))
def _(spark, d):
    return relations(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.min("from_id").alias("first_from"), F.max("to_id").alias("last_to"))


@register(
    "s25_dangling_drop",
    sql("""select kind, count(*) as n_loaded from rel
    where from_id in (select id from entity where not (kind in ('Method', 'StatisticalMethod') and id like '%7'))
      and to_id in (select id from entity where not (kind in ('Method', 'StatisticalMethod') and id like '%7')) group by kind"""),
)
def _(spark, d):
    entity, rel = graph(spark, d)
    some = entity.where(~(F.col("kind").isin("Method", "StatisticalMethod") & F.col("id").endswith("7")))
    return T.without_dangling(some, rel).groupBy("kind").agg(F.count("*").alias("n_loaded"))


@register("p1_kind_filter", sql("select id, name, bioconda_pkg from entity where kind = 'Method'"))
def _(spark, d):
    return entities(spark, d, "Method").select("id", "name", "bioconda_pkg")


@register("p2_membership", sql("select from_id, to_id, kind from rel where from_id in ('m:1', 'm:2', 'stat:3') and kind <> 'WRAPS'"))
def _(spark, d):
    rel = relations(spark, d).where("kind <> 'WRAPS'")
    return T.members(rel, "from_id", ids(spark, "m:1", "m:2", "stat:3")).select("from_id", "to_id", "kind")


@register("p3_keyword_contains", "select doc_id, lang from documents where contains(lower(text), lower('Toned')) or contains(lower(source), lower('toned'))")
def _(spark, d):
    docs = star(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("name"), F.col("text").alias("properties"))
    return docs.where(T.matches(F.lit("Toned"))).select("doc_id", "lang")


@register(
    "p4_endpoint_kinds",
    sql("""select r.kind, a.kind as from_kind, b.kind as to_kind, count(*) as n from rel r join entity a on a.id = r.from_id join entity b on b.id = r.to_id group by 1, 2, 3"""),
)
def _(spark, d):
    entity, rel = graph(spark, d)
    return T.endpoints(rel, entity).where("from_kind is not null and to_kind is not null").groupBy("kind", "from_kind", "to_kind").agg(F.count("*").alias("n"))


@register(
    "p5_or_exists",
    """select p_partkey, p_brand from part p where exists (select 1 from lineitem l where l.l_partkey = p.p_partkey and l_quantity > 49 and l_discount > 0.09)
    or exists (select 1 from lineitem l join orders o on o.o_orderkey = l.l_orderkey where l.l_partkey = p.p_partkey and o_totalprice > 490000)""",
)
def _(spark, d):
    part, line, orders = star(spark, d, "part"), star(spark, d, "lineitem"), star(spark, d, "orders")
    one = line.where("l_quantity > 49 and l_discount > 0.09").select(F.col("l_partkey").alias("k"))
    two = line.join(orders.where("o_totalprice > 490000"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_partkey").alias("k"))
    return part.join(one.unionByName(two).distinct(), F.col("p_partkey") == F.col("k"), "left_semi").select("p_partkey", "p_brand")


@register("p6_json_props", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events where json_extract_string(props, '$.k') is not null")
def _(spark, d):
    k = F.get_json_object("props", "$.k")
    return star(spark, d, "events").where(k.isNotNull()).select("event_id", k.cast("long").alias("k"))


@register(
    "p7_prefix_allowlist",
    sql("""select from_id, to_id from rel where kind = 'USES_STATISTICAL_METHOD' and not (
    starts_with(lower(trim(json_extract_string(properties, '$.evidence'))), 'doi:') or starts_with(lower(trim(json_extract_string(properties, '$.evidence'))), 'pmid:'))"""),
)
def _(spark, d):
    from lattix.operators.audit import grounded

    rel = relations(spark, d, "USES_STATISTICAL_METHOD")
    return rel.where(~grounded(F.get_json_object("properties", "$.evidence"))).select("from_id", "to_id")


@register("p8_distinct_projection", sql("select distinct to_id from rel where kind in ('INPUT', 'OUTPUT')"))
def _(spark, d):
    return relations(spark, d, "INPUT", "OUTPUT").select("to_id").distinct()


@register("p9_provenance_missing", sql("select id, kind from entity where source is null or source = '' or source_url is null or source_url = '' or ingested_at is null or ingested_at = ''"))
def _(spark, d):
    return T.missing_provenance(entities(spark, d)).select("id", "kind")


@register(
    "p10_anti_filter",
    sql("""select from_id, to_id from rel where kind = 'PERFORMS' and (from_id, to_id) not in (
      select from_id, to_id from rel where kind = 'PERFORMS' and from_id like '%3')"""),
)
def _(spark, d):
    rel = relations(spark, d, "PERFORMS")
    return T.without_edges(rel, rel.where(F.col("from_id").endswith("3"))).select("from_id", "to_id")


@register(
    "p11_all_keywords",
    sql("select id from entity where kind = 'Skill' and contains(lower(name), 'ar') and contains(lower(name), 'a')"),
)
def _(spark, d):
    return T.with_all_keywords(entities(spark, d, "Skill"), ["AR", "a"]).select("id")


def _hops(k: int) -> str:
    steps = "".join(f", h{i} as (select id from h{i - 1} union select b from both_ways join h{i - 1} on a = id)" for i in range(1, k + 1))
    return f"both_ways as (select from_id as a, to_id as b from rel union all select to_id, from_id from rel), h0 as (select id from entity where id in ('stat:7', 'assum:1', 'nowhere')){steps}"


for _k in (1, 2, 3):
    _oracle = sql_with(_hops(_k), f"select kind, count(*) as n from rel where from_id in (select id from h{_k}) and to_id in (select id from h{_k}) group by kind")

    @register(f"j1_khop_subgraph_k{_k}", _oracle)
    def _(spark, d, k=_k):
        entity, rel = graph(spark, d)
        _, edges = T.seed_subgraph(entity, rel, ids(spark, "stat:7", "assum:1", "nowhere"), k)
        return edges.groupBy("kind").agg(F.count("*").alias("n"))


_WALK = """with recursive e as (
    select 'm:' || cast(l_partkey as varchar) as a, 'stat:' || cast(l_suppkey as varchar) as b from (select distinct l_partkey, l_suppkey from lineitem where l_partkey % 7 <> 0) x
    union all select 'stat:' || cast(s_suppkey as varchar), 'assum:' || cast(s_nationkey as varchar) from supplier
    union all select 'assum:' || cast(n_nationkey as varchar), 'diag:' || cast(n_regionkey as varchar) from nation where n_nationkey % 6 <> 5),
  walk(id, hop) as (select 'm:' || cast(p_partkey as varchar), 0 from part where p_partkey <= 50
    union all select e.b, hop + 1 from walk join e on e.a = walk.id where hop < 3)
  select id, min(hop) as hop from walk group by id"""


@register("j1_recursive_reach", _WALK)
def _(spark, d):
    rel = relations(spark, d, "USES_STATISTICAL_METHOD", "REQUIRES_ASSUMPTION", "CHECKED_BY")
    seeds = star(spark, d, "part").where("p_partkey <= 50").select(F.concat(F.lit("m:"), F.col("p_partkey").cast("string")).alias("id"))
    return T.reach(rel, seeds, 3, ["USES_STATISTICAL_METHOD", "REQUIRES_ASSUMPTION", "CHECKED_BY"])


_KEYWORDS = ["nation_1", "azure", "brand#1"]


def keyword_ctes(words: list[str]) -> str:
    """``firsts``: (id, kw, branch) of what the words find, n = 1 where an id comes first."""
    values = ", ".join(f"({k}, '{w}')" for k, w in enumerate(words))
    return f"""kw(kw, word) as (values {values}),
    hit as (select kw, id, kind from entity, kw where contains(lower(name), lower(word)) or contains(lower(properties), lower(word))),
    s1 as (select distinct kw, from_id from rel join hit on to_id = hit.id where hit.kind <> 'Method'),
    s2 as (select distinct kw, rel.from_id from rel join s1 on rel.to_id = s1.from_id),
    every as (select kw, 0 as branch, id from hit where kind = 'Method' union
      select kw, 1, from_id from (select * from s1 union select * from s2) s where from_id in (select id from entity where kind = 'Method') union
      select kw, 2, id from hit where kind = 'Assumption'),
    firsts as (select id, kw, branch, row_number() over (partition by id order by kw, branch) as n from every)"""


@register("j2_keyword_resolution", sql_with(keyword_ctes(_KEYWORDS), "select row_number() over (order by kw, branch, id)::int as ord, id from firsts where n = 1"))
def _(spark, d):
    entity, rel = graph(spark, d)
    return T.resolve_keywords(entity, rel, _KEYWORDS)


@register(
    "j3_neighborhood",
    sql_with(
        """ev as (select from_id, to_id, kind, coalesce(json_extract_string(properties, '$.evidence'), '') as evidence from rel),
    every as (
      select from_id as method_id, case kind when 'PERFORMS' then 'operations' when 'PACKAGED_AS' then 'packages' when 'INPUT' then 'inputs' else 'outputs' end as bucket, to_id as id, '' as via, '' as evidence
        from ev where kind in ('PERFORMS', 'PACKAGED_AS', 'INPUT', 'OUTPUT') union all
      select from_id, 'statistics', to_id, '', evidence from ev where kind = 'USES_STATISTICAL_METHOD' union all
      select u.from_id, 'assumptions', q.to_id, s.name, q.evidence from ev u join ev q on q.kind = 'REQUIRES_ASSUMPTION' and q.from_id = u.to_id join entity s on s.id = u.to_id where u.kind = 'USES_STATISTICAL_METHOD' union all
      select p.from_id, 'amenable', a.to_id, o.name, a.evidence from ev p join ev a on a.kind = 'AMENABLE_TO' and a.from_id = p.to_id join entity o on o.id = p.to_id where p.kind = 'PERFORMS')""",
        """select method_id, bucket, e.id, n.name, coalesce(string_agg(distinct nullif(via, ''), '|' order by nullif(via, '')), '') as via, max(evidence) as evidence
    from every e join entity n on n.id = e.id where method_id in (select id from entity where kind = 'Method') group by 1, 2, 3, 4""",
    ),
)
def _(spark, d):
    nodes = ["Method", "Operation", "Container", "Data", "StatisticalMethod", "Assumption"]
    edges = [*T.BUCKETS.values(), "REQUIRES_ASSUMPTION", "AMENABLE_TO"]
    return T.neighbourhood(*graph(spark, d, nodes=nodes, edges=edges))


@register(
    "j9_skill_methods",
    sql("""select from_id as skill_id, row_number() over (partition by from_id order by to_id)::int as ord, to_id as method_id
    from (select distinct from_id, to_id from rel where kind = 'WRAPS' and starts_with(from_id, 'skill:')) x"""),
)
def _(spark, d):
    return T.skill_methods(relations(spark, d, "WRAPS"))


@register(
    "j14_evidence_edges",
    sql("""select m.id as method_id from entity m where m.kind = 'Method' and not exists (
    select 1 from rel r where r.from_id = m.id and r.kind in ('PERFORMS', 'INPUT', 'OUTPUT'))"""),
)
def _(spark, d):
    entity, rel = graph(spark, d, nodes=["Method"], edges=["PERFORMS", "INPUT", "OUTPUT"])
    some = T.of_kind(rel, "PERFORMS", "INPUT", "OUTPUT").select(F.col("from_id").alias("id"))
    return T.of_kind(entity, "Method").join(some, "id", "left_anti").select(F.col("id").alias("method_id"))


CONTRACT = """
  uses as (select distinct from_id as method_id, to_id as stat from rel where kind = 'USES_STATISTICAL_METHOD'),
  req as (select from_id as stat, to_id as assumption_id, coalesce(json_extract_string(properties, '$.evidence'), '') as evidence from rel where kind = 'REQUIRES_ASSUMPTION'),
  perf as (select distinct from_id as method_id, to_id as op from rel where kind = 'PERFORMS'),
  amen as (select from_id as op, to_id as stat from rel where kind = 'AMENABLE_TO'),
  paths as (
    select method_id, 'used' as source, assumption_id, uses.stat as via_id, evidence from uses join req on req.stat = uses.stat union all
    select method_id, 'amenable', assumption_id, op, evidence from perf join (select distinct op, assumption_id, evidence from amen join req on req.stat = amen.stat) using (op)),
  diag as (select id as diagnostic_id, json_extract_string(properties, '$.checkable') as checkable, json_extract_string(properties, '$.applies_to_assumption') as scope,
      cast(json_extract_string(properties, '$.min_replicates_per_group') as bigint) as floor from entity where kind = 'Diagnostic'),
  chk as (select distinct from_id as assumption_id, to_id as diagnostic_id from rel where kind = 'CHECKED_BY'),
  crows as (select p.*, v.name as via, a.name as assumption, c.diagnostic_id, d.checkable, d.scope, d.floor
    from paths p join entity v on v.id = p.via_id join entity a on a.id = p.assumption_id
    left join (chk c join diag d on d.diagnostic_id = c.diagnostic_id) on c.assumption_id = p.assumption_id),
  contract as (
    select method_id, assumption_id, source, min(assumption) as assumption, coalesce(arg_min(evidence, via || chr(1) || evidence) filter (evidence <> ''), '') as evidence,
      string_agg(distinct via, '|' order by via) as via, max(case checkable when 'pre_run' then 2 when 'post_run' then 1 else 0 end) as rank,
      coalesce(string_agg(distinct diagnostic_id, '|' order by diagnostic_id), '') as diagnostics,
      max(case when scope = '' or scope = assumption_id then floor end) as floor
    from crows group by 1, 2, 3),
  facts as (select 'm:' || cast(l_partkey as varchar) as method_id, cast(min(l_quantity) as bigint) + 2 as value from lineitem where l_linenumber = 1 and l_returnflag = 'R' group by 1),
  gate0 as (
    select c.method_id, assumption_id, source, assumption, evidence, diagnostics, case when rank = 1 then 'post_run' else 'pre_run' end as phase,
      case when rank = 2 and source <> 'amenable' and floor is not null then 'replicates_per_group' end as key,
      case when rank = 2 and source <> 'amenable' then floor end as threshold, f.value
    from contract c left join facts f on f.method_id = c.method_id),
  gate1 as (select *, max(key is not null) over (partition by method_id, assumption, phase) as keyed,
      row_number() over (partition by method_id, assumption, phase, case when phase = 'post_run' then diagnostics else coalesce(key, '') end order by source desc, assumption_id) as n from gate0),
  gates as (
    select method_id, assumption, phase, key, threshold, case when key is not null then value end as supplied,
      case when phase = 'post_run' then null when key is null then 'REQUIRES_REVIEW' when value is null then 'INSUFFICIENT_INFO' when value >= threshold then 'PASS' else 'FAIL' end as result,
      evidence, diagnostics from gate1 where (phase = 'post_run' or key is not null or not keyed)
      and (select 1) = 1 qualify row_number() over (partition by method_id, assumption, phase, case when phase = 'post_run' then diagnostics else coalesce(key, '') end order by source desc, assumption_id) = 1),
  sums as (select method_id, count(*) filter (result = 'PASS') as n_pass, count(*) filter (result = 'FAIL') as n_fail, count(*) filter (result = 'INSUFFICIENT_INFO') as n_missing,
      count(*) filter (result = 'REQUIRES_REVIEW') as n_review, count(*) filter (phase = 'post_run') as n_post_run, max(key) as required_facts from gates group by 1),
  verdict as (select e.id as method_id, case when n_fail is null then 'NOT_EVALUABLE' when n_fail > 0 then 'BLOCKED' when n_missing > 0 then 'FACTS_REQUIRED' else 'EVALUABLE' end as status,
      coalesce(n_pass, 0) as n_pass, coalesce(n_fail, 0) as n_fail, coalesce(n_missing, 0) as n_missing, coalesce(n_review, 0) as n_review, coalesce(n_post_run, 0) as n_post_run,
      coalesce(required_facts, '') as required_facts from entity e left join sums s on s.method_id = e.id where e.kind = 'Method'),
  reads as (select from_id as method_id, list_sort(list(distinct to_id)) as ids from rel where kind = 'INPUT' group by 1),
  writes as (select from_id as method_id, list_sort(list(distinct to_id)) as ids from rel where kind = 'OUTPUT' group by 1),
  steps as (select l_orderkey as chain, 'm:' || cast(l_partkey as varchar) as method_id,
      row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::int as ord from lineitem)"""


def contract_graph(spark: SparkSession, d: str, *, nodes: list[str] | None = None, edges: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The kinds that contracts rest on, with more ``nodes`` and ``edges``."""
    nodes = ["StatisticalMethod", "Operation", "Assumption", "Diagnostic", *(nodes or [])]
    edges = ["USES_STATISTICAL_METHOD", "REQUIRES_ASSUMPTION", "PERFORMS", "AMENABLE_TO", "CHECKED_BY", *(edges or [])]
    return graph(spark, d, nodes=nodes, edges=edges)


@register("j4_contract_rows", sql_with(CONTRACT, "select method_id, source, assumption_id, via, evidence, diagnostic_id, floor as min_replicates_per_group from crows"))
def _(spark, d):
    return K.contract_rows(*contract_graph(spark, d)).select("method_id", "source", "assumption_id", "via", "evidence", "diagnostic_id", "min_replicates_per_group")


@register(
    "a1_contract_fold",
    sql_with(
        CONTRACT,
        """select method_id, assumption_id, source, assumption, evidence, via, case rank when 2 then 'pre_run' when 1 then 'post_run' else '' end as checkable,
    diagnostics, floor as min_replicates_per_group from contract""",
    ),
)
def _(spark, d):
    c = K.contracts(*contract_graph(spark, d))
    return c.select("method_id", "assumption_id", "source", "assumption", "evidence", F.array_join("via", "|").alias("via"), "checkable", F.array_join("diagnostics", "|").alias("diagnostics"), "min_replicates_per_group")


@register("j4_diagnostic_registry", sql_with(CONTRACT, "select method_id, diagnostic_id, string_agg(distinct assumption, '|' order by assumption) as checks from crows where diagnostic_id is not null group by 1, 2"))
def _(spark, d):
    return K.diagnostics_of(K.contracts(*contract_graph(spark, d))).select("method_id", "diagnostic_id", F.array_join("checks", "|").alias("checks"))


@register(
    "a2_skill_merge",
    sql_with(
        CONTRACT
        + """, mem as (select from_id as skill_id, to_id as method_id, row_number() over (partition by from_id order by to_id) as ord from (select distinct from_id, to_id from rel where kind = 'WRAPS' and starts_with(from_id, 'skill:')) x)""",
        """select skill_id, assumption_id, source, arg_min(assumption, ord) as assumption, arg_min(evidence, ord) as evidence, arg_min(via, ord) as via,
    case max(rank) when 2 then 'pre_run' when 1 then 'post_run' else '' end as checkable, max(floor) as min_replicates_per_group from mem join contract using (method_id) group by 1, 2, 3""",
    ),
)
def _(spark, d):
    entity, rel = contract_graph(spark, d, edges=["WRAPS"])
    wrapped = T.skill_methods(rel)
    m = K.merge_contracts(K.contracts(entity, rel, wrapped), wrapped)
    return m.select("skill_id", "assumption_id", "source", "assumption", "evidence", F.array_join("via", "|").alias("via"), "checkable", "min_replicates_per_group")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Measured facts: of the first lines that came back, a part's least quantity plus two is its smallest arm; other parts
    have no facts."""
    line = star(spark, d, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("l_quantity").alias("q"))
    return line.select(F.concat(F.lit("m:"), F.col("l_partkey").cast("string")).alias("method_id"), F.lit("replicates_per_group").alias("key"), (F.col("q").cast("long") + 2).alias("value"))


def step_gates(spark: SparkSession, d: str, *, nodes: list[str] | None = None, edges: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    entity, rel = contract_graph(spark, d, nodes=nodes, edges=edges)
    return entity, rel, V.gates(K.contracts(entity, rel), facts(spark, d))


@register("d1_gates", sql_with(CONTRACT, "select method_id, assumption, phase, key, threshold, supplied, result, evidence, diagnostics from gates"))
def _(spark, d):
    return step_gates(spark, d)[2].withColumn("diagnostics", F.array_join("diagnostics", "|"))


def step_verdicts(spark: SparkSession, d: str, *, nodes: list[str] | None = None, edges: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    entity, rel, gates = step_gates(spark, d, nodes=["Method", *(nodes or [])], edges=edges)
    return entity, rel, V.verdicts(T.of_kind(entity, "Method").select(F.col("id").alias("method_id")), gates)


@register("d1_step_verdict", sql_with(CONTRACT, "select * from verdict"))
def _(spark, d):
    return step_verdicts(spark, d)[2].drop("refusal_reason").withColumn("required_facts", F.array_join("required_facts", "|"))


def chain_steps(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = star(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).alias("ord"))
    return line.select(F.col("l_orderkey").alias("chain"), F.concat(F.lit("m:"), F.col("l_partkey").cast("string")).alias("method_id"), "ord")


_HAND = """select chain, ord, method_id, next_method_id, case when len(coalesce(w, [])) = 0 or len(coalesce(nr, [])) = 0 then 'UNKNOWN' when len(list_intersect(w, nr)) > 0 then 'VALID' else 'BROKEN' end as handoff
  from (select chain, ord, s.method_id, lead(s.method_id) over o as next_method_id, {w} as w, lead({r}) over o as nr
    from steps s left join reads r on r.method_id = s.method_id left join writes x on x.method_id = s.method_id left join verdict v on v.method_id = s.method_id window o as (partition by chain order by ord)) y
  where next_method_id is not null"""


@register("d3_handoff", sql_with(CONTRACT, _HAND.format(w="x.ids", r="r.ids")))
def _(spark, d):
    return V.handoffs(chain_steps(spark, d), relations(spark, d, "INPUT", "OUTPUT")).drop("shared")


@register(
    "d4_chain_verdict",
    sql_with(
        CONTRACT
        + ", hand as ("
        + _HAND.format(w="case when v.status <> 'NOT_EVALUABLE' then x.ids end", r="case when v.status <> 'NOT_EVALUABLE' then r.ids end")
        + """), sv as (select chain, count(*) as n_steps, count(*) filter (status = 'BLOCKED') as n_blocked, count(*) filter (status = 'NOT_EVALUABLE') as n_unknown, count(*) filter (status = 'FACTS_REQUIRED') as n_facts
      from steps join verdict using (method_id) group by 1), hv as (select chain, count(*) filter (handoff = 'BROKEN') as n_broken, count(*) filter (handoff = 'VALID') as n_valid from hand group by 1)""",
        """select chain, n_steps, n_blocked, n_unknown, n_facts, coalesce(n_broken, 0) as n_broken, coalesce(n_valid, 0) as n_valid,
    case when n_blocked > 0 or coalesce(n_broken, 0) > 0 then 'BLOCKED' when n_unknown > 0 then 'NOT_EVALUABLE' when n_facts > 0 then 'FACTS_REQUIRED' else 'EVALUABLE' end as status from sv left join hv using (chain)""",
    ),
)
def _(spark, d):
    _, rel, verdicts = step_verdicts(spark, d, edges=["INPUT", "OUTPUT"])
    verdicts = cut(verdicts.select("method_id", "status"))  # asked twice
    steps = chain_steps(spark, d)
    known = verdicts.where("status <> 'NOT_EVALUABLE'")
    return V.chain_verdicts(steps, steps, verdicts, V.handoffs(steps, rel, known))


@register(
    "d13_context_text",
    sql_with(
        _hops(1)
        + """, node as (select * from entity where id in (select id from h1)),
    edge as (select from_id, to_id, kind from rel where from_id in (select id from h1) and to_id in (select id from h1)),
    lines as (select 0 as part, id as k1, '' as k2, '' as k3, kind || ': ' || name || case when properties in ('', '{}') then '' else ' ' || properties end as line from node
      union all select 1, from_id, e.kind, to_id, a.name || ' -[' || e.kind || ']-> ' || b.name from edge e join node a on a.id = from_id join node b on b.id = to_id)""",
        "select row_number() over (order by part, k1, k2, k3)::int as ord, line from lines",
    ),
)
def _(spark, d):
    entity, rel = graph(spark, d)
    return T.context_text(entity, rel, ids(spark, "stat:7", "assum:1", "nowhere"), 1)
