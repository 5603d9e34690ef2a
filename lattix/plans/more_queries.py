"""Registered queries of the smaller operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattix.graph import PropertyGraph
from lattix.operators import contract as K
from lattix.operators import evalkit as E
from lattix.operators import planner as P
from lattix.operators import runner as N
from lattix.operators import traverse as T
from lattix.plans.bridge import entities, graph, sql, sql_with, star
from lattix.plans.build_queries import _SUGGEST, sequences, text
from lattix.plans.graph_queries import CONTRACT, contract_graph, ids, keyword_ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@register("j5_continuations", sql_with(_SUGGEST, "select module_id, n as count, via, why from cont where k = 1"))
def _(spark, d):
    return P.continuations(*graph(spark, d, nodes=["Module"], edges=["DOWNSTREAM_OF"]), ids(spark, "mod:brand1", "data:2"))


@register("j6_entries", sql_with(_SUGGEST, "select module_id, n as count, via, why from entr"))
def _(spark, d):
    return P.entries(*graph(spark, d, nodes=["Module"], edges=["INPUT", "WRAPS", "HAS_MODULE"]), ids(spark, "mod:brand1", "data:2"))


@register("j7_executors", sql_with(_SUGGEST, "select module_id, method_id, alternatives, container from ex left join img using (method_id)"))
def _(spark, d):
    return P.executors(*graph(spark, d, nodes=["Method", "Container"], edges=["WRAPS", "PACKAGED_AS"]))


@register(
    "j8_causal_frontier",
    sql_with(
        keyword_ctes(["STANDARD", "brand", "nation", "3"]) + ", found as (select row_number() over (order by kw, branch, id)::int as ord, id from firsts where n = 1)",
        "select 0 as ord, 'data:1' as id union all select min(ord), from_id from rel join found on found.id = to_id where kind = 'WRAPS' and starts_with(from_id, 'mod:') group by 2",
    ),
)
def _(spark, d):
    return P.frontier_of_labels(*graph(spark, d), ["STANDARD brand", "nation_3"], "data:1")


_NEAR = """nb as (select r.from_id as method_id, r.kind, n.id, n.name from rel r join entity n on n.id = r.to_id where r.kind in ('PERFORMS', 'INPUT', 'OUTPUT', 'PACKAGED_AS')),
  agg as (select method_id, coalesce(string_agg(distinct name, '|' order by name) filter (kind = 'PERFORMS'), '') as operations, coalesce(string_agg(distinct name, '|' order by name) filter (kind = 'INPUT'), '') as inputs,
    coalesce(string_agg(distinct name, '|' order by name) filter (kind = 'OUTPUT'), '') as outputs, arg_min(name, id) filter (kind = 'PACKAGED_AS') as container from nb group by 1)"""


@register(
    "d12_catalogue",
    sql_with(
        _NEAR,
        """select e.id as method_id, e.name, coalesce(operations, '') as operations, coalesce(inputs, '') as inputs, coalesce(outputs, '') as outputs, container,
    (case when container is not null then 0.8 else 0.5 end)::double as reproducibility from entity e left join agg on agg.method_id = e.id where e.kind = 'Method'""",
    ),
)
def _(spark, d):
    c = PropertyGraph(spark, *graph(spark, d, nodes=["Method", "Operation", "Data", "Container"], edges=["PERFORMS", "PACKAGED_AS", "INPUT", "OUTPUT"])).catalogue()
    listed = [F.coalesce(F.array_join(x, "|"), F.lit("")).alias(x) for x in ("operations", "inputs", "outputs")]
    return c.select("method_id", "name", *listed, "container", "reproducibility")


_FILES = [("a.yaml", "doi: '10.3/9'\npmid: 1"), ("b.yaml", "doi: '10.3/18', pmid: 12")]


@register(
    "d7_explain",
    sql_with(CONTRACT + ", files(path, body) as (values ('a.yaml', 'doi: ''10.3/9''' || chr(10) || 'pmid: 1'), ('b.yaml', 'doi: ''10.3/18'', pmid: 12'))", "select method_id, assumption_id, evidence, path from contract, files where evidence <> '' and contains(body, regexp_replace(evidence, '^[a-z]+:', ''))"),
)
def _(spark, d):
    files = spark.createDataFrame(_FILES, "path string, text string")
    return K.evidence_sources(K.contracts(*contract_graph(spark, d)), files)


@register("d11_ledger_order", "select event_id as entry_id, row_number() over (order by ts, event_id)::int as ord from events where event_type = 'purchase'")
def _(spark, d):
    e = star(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("entry_id"), F.col("ts").alias("recorded_at"))
    return P.with_order(e).select("entry_id", "ord")


@register(
    "a15_build_manifest",
    "select count(*) filter (c_acctbal > 0) as n_used, count(*) filter (c_acctbal <= 0) as n_dropped, coalesce(sum(c_nationkey) filter (c_acctbal > 0), 0)::bigint as n_items from customer",
)
def _(spark, d):
    used = F.col("c_acctbal") > 0
    c = star(spark, d, "customer").select(F.when(used, "used").otherwise("dropped").alias("status"), F.when(~used, "no balance").alias("reason"), F.col("c_nationkey").alias("n_items"))
    return N.build_manifest(c)


@register("a3_counts_by_kind", sql("select kind, count(*) as n, count(distinct name) as n_names from entity group by 1"))
def _(spark, d):
    return entities(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("n_names"))


@register("w1_first_occurrence", "select l_partkey, min(l_orderkey) as l_orderkey from lineitem group by 1")
def _(spark, d):
    w = Window.partitionBy("l_partkey").orderBy("l_orderkey")
    return star(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.row_number().over(w).alias("n")).where("n = 1").drop("n")


@register("w4_prefix_sets", "select user_id, event_id, count(*) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as n_before from events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return star(spark, d, "events").select("user_id", "event_id", F.count("*").over(w).alias("n_before"))


@register("w5_positions", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::int as pos from lineitem")
def _(spark, d):
    rows = star(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("s"))
    x = rows.select("l_orderkey", F.posexplode("s").alias("k", "s"))
    return x.select("l_orderkey", "s.l_linenumber", "s.l_partkey", "s.l_suppkey", (F.col("k") + 1).alias("pos"))


@register("w11_limit_zero", "select n_nationkey from nation limit 0")
def _(spark, d):
    return star(spark, d, "nation").select("n_nationkey").limit(0)


@register("g6_matching")
def _(spark, d):
    o = E.oracle(*graph(spark, d, nodes=["Method"], edges=["WRAPS", "PERFORMS", "INPUT", "OUTPUT"]))
    return E.matched_by_class(sequences(spark, d, 0), sequences(spark, d, 1), o["operations"], o["inputs"])


@register(
    "e11_rescore",
    "with g as (select l_orderkey, count(distinct l_partkey) as g, count(distinct p_partkey) as h from lineitem left join part on p_partkey = l_partkey group by 1) select 'whole' as task, count(*) as n, min(2.0::double * h / (h + g)) as least_f1 from g",
)
def _(spark, d):
    from pyspark.sql import types as Y

    entity = entities(spark, d, "Method")
    lines = star(spark, d, "lineitem")
    seq = lines.groupBy(text("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("m:"), text("l_partkey")))).alias("s"))
    gold = F.struct(F.col("s").alias("sequence"), F.get("s", F.lit(0)).alias("next"))
    items = seq.select("id", F.lit("whole").alias("task"), gold.alias("gold"), F.to_json(F.transform("s", lambda x: F.replace(x, F.lit("m:"), F.lit("")))).alias("raw"))
    results = items.select("id", "task", "raw", F.lit(None).cast(Y.StringType()).alias("error"))
    return N.rescore(results, items, T.of_kind(entity, "Method")).groupBy("task").agg(F.count("*").alias("n"), F.min("f1").alias("least_f1"))
