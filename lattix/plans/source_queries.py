"""Registered queries of the readers and the curated layers, over files made of the star schema, with their SQL.

Files are written to the shared folder first, in the forms that the readers expect, and read from there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.operators import runner, triage
from lattix.operators import traverse as T
from lattix.plans.bridge import entities, graph, sql, sql_with, star
from lattix.plans.build_queries import text
from lattix.plans.runtime import shared_dir
from lattix.sources import curated as C
from lattix.sources import modules, owl, pipelines, recipes, registry, skills, tsv

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = "2024-01-01"


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: str) -> None:
    """A small file by name, where Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content.encode()))
    out.close()


def one_each(df: DataFrame, path: str) -> str:
    """Rows of a text column as a folder of files with one row each."""
    df.write.option("maxRecordsPerFile", 1).text(path)
    return path


# ---- ontologies


def ontology(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Regions and nations as classes of a table; every sixth nation is obsolete."""
    uri = lambda c: F.concat(F.lit("http://o/operation_"), c.cast("string"))
    r = star(spark, d, "region").select(uri(F.col("r_regionkey") + 100).alias("Class ID"), F.col("r_name").alias("Preferred Label"), F.lit(None).cast("string").alias("Parents"), F.lit("FALSE").alias("Obsolete"), F.lit(None).cast("string").alias("Synonyms"))
    n = star(spark, d, "nation").select(
        uri(F.col("n_nationkey")).alias("Class ID"), F.col("n_name").alias("Preferred Label"), uri(F.col("n_regionkey") + 100).alias("Parents"), F.when(F.col("n_nationkey") % 6 == 5, "TRUE").otherwise("FALSE").alias("Obsolete"),
        F.concat(F.lower("n_name"), F.lit("|a")).alias("Synonyms"),
    )
    path = folder(spark, "ontology")
    r.unionByName(n).write.option("sep", "\t").option("header", True).csv(path)
    return tsv.parse_ontology_table(spark, path, ingested_at=DAY)


@register(
    "s1_ontology_entities",
    """select 'op:operation_' || (r_regionkey + 100) as id, r_name as name, 'Operation' as kind, '{"uri": "http://o/operation_' || (r_regionkey + 100) || '"}' as properties from region union all
    select 'op:operation_' || n_nationkey, n_name, 'Operation', '{"synonyms": ["a", "' || lower(n_name) || '"], "uri": "http://o/operation_' || n_nationkey || '"}' from nation where n_nationkey % 6 <> 5""",
)
def _(spark, d):
    return ontology(spark, d)[0].select("id", "name", "kind", "properties")


@register("s1_ontology_edges", "select 'op:operation_' || n_nationkey as from_id, 'op:operation_' || (n_regionkey + 100) as to_id from nation where n_nationkey % 6 <> 5")
def _(spark, d):
    return ontology(spark, d)[1].select("from_id", "to_id")


@register(
    "s3_obi_assays",
    """select 'obo:N_' || n_nationkey as id, n_name as name, 'Assay' as kind from nation where n_regionkey = 0 and n_nationkey % 6 <> 5 union all select 'obo:OBI_0000070', r_name, 'Assay' from region where r_regionkey = 0""",
)
def _(spark, d):
    """The first region is the root of assays, its nations are below it; deprecated ones are no nodes."""
    n, r = star(spark, d, "nation"), star(spark, d, "region")
    local = F.when(F.col("r_regionkey") == 0, "OBI_0000070").otherwise(F.concat(F.lit("R_"), text("r_regionkey")))
    cls = lambda uri, label, more: F.concat(F.lit('<owl:Class rdf:about="http://p/'), uri, F.lit('"><rdfs:label>'), label, F.lit("</rdfs:label>"), more, F.lit("</owl:Class>"))
    tops = r.select(cls(local, F.col("r_name"), F.lit("")).alias("c"))
    up = F.when(F.col("n_regionkey") == 0, "OBI_0000070").otherwise(F.concat(F.lit("R_"), text("n_regionkey")))
    more = F.concat(F.lit('<rdfs:subClassOf rdf:resource="http://p/'), up, F.lit('"/>'), F.when(F.col("n_nationkey") % 6 == 5, "<owl:deprecated>true</owl:deprecated>").otherwise(""))
    below = n.select(cls(F.concat(F.lit("N_"), text("n_nationkey")), F.col("n_name"), more).alias("c"))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
    whole = tops.unionByName(below).agg(F.concat(F.lit(head), F.array_join(F.collect_list("c"), ""), F.lit("</rdf:RDF>")).alias("value"))  # thirty classes
    return owl.parse_obi(spark, one_each(whole, folder(spark, "owl")), ingested_at=DAY)[0].select("id", "name", "kind")


# ---- modules, pipelines, recipes


def tools(spark: SparkSession, d: str) -> DataFrame:
    """The read manifests of one module per brand."""
    root = folder(spark, "modules")
    for (brand,) in star(spark, d, "part").select("p_brand").distinct().collect():  # twenty-five, by the schema
        b = brand.lower().replace("#", "")
        at = f"{root}/nf-core/{b}"
        put(spark, f"{at}/meta.yml", f"name: {b}\ndescription: of {brand}\ntools:\n  - {b}: {{identifier: 'biotools:{b.upper()}', edam_operations: ['http://e/operation_{b[-2:]}', 'http://e/topic_1']}}\ninput:\n  - - x: {{pattern: '*.{{bam,sam}}'}}\noutput:\n  - y: {{pattern: '*.{b}', ontologies: [{{edam: 'http://e/data_{b[-1]}'}}]}}\n")
        put(spark, f"{at}/environment.yml", f"dependencies: ['bioconda::{b}=1.{b[-1]}']\n")
    put(spark, f"{root}/nf-core/broken/meta.yml", "name: [\n")
    return modules.read_modules(spark, root)


_BRANDS = "b as (select distinct lower(replace(p_brand, '#', '')) as b, p_brand from part)"


@register(
    "s5_module_edges",
    f"""with {_BRANDS} select 'mod:' || b as from_id, 'WRAPS' as kind, 'm:' || b as to_id from b union all select 'm:' || b, 'PERFORMS', 'op:operation_' || right(b, 2) from b
    union all select 'm:' || b, 'INPUT', unnest(['fmt:format_2572', 'fmt:format_2573']) from b union all select 'm:' || b, 'OUTPUT', unnest(['data:data_' || right(b, 1), 'fmt:pat:.' || b]) from b""",
)
def _(spark, d):
    return modules.build_modules(tools(spark, d), ingested_at=DAY)[1].select("from_id", "kind", "to_id")


@register(
    "s5_module_entities",
    f"""with {_BRANDS} select 'mod:' || b as id, b as name, 'Module' as kind, '{{"description": "of ' || p_brand || '"}}' as properties, '' as bioconda_pkg, '' as biotools_id from b
    union all select 'm:' || b, b, 'Method', '{{"tool_label": "' || b || '", "version": "1.' || right(b, 1) || '"}}', b, upper(b) from b union all select 'fmt:pat:.' || b, '.' || b, 'Format', '{{"pattern": ".' || b || '"}}', '', '' from b""",
)
def _(spark, d):
    return modules.build_modules(tools(spark, d), ingested_at=DAY)[0].select("id", "name", "kind", "properties", "bioconda_pkg", "biotools_id")


@register("s24_wanted_ids", f"with {_BRANDS} select 'package' as what, b as id from b union all select 'registry', b from b")
def _(spark, d):
    return registry.wanted_ids(tools(spark, d).where("error is null"))


_MEMBERS = "mem as (select distinct l_orderkey as pipeline, 'mod:' || lower(replace(p_brand, '#', '')) as module_id from lineitem join part on p_partkey = l_partkey where p_size <> 50)"


def membership(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as pipelines: members and the flow inferred from what brands read and write; parts of the largest size are in no module."""
    x = star(spark, d, "lineitem").join(star(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    b = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    declared = x.select(text("l_orderkey").alias("pipeline"), F.when(F.col("p_size") == 50, "gone").otherwise(b).alias("path"))
    metas = star(spark, d, "part").select(b.alias("path"), F.concat(F.lit("mod:"), b).alias("module_id")).distinct()
    io = lambda n: metas.select("module_id", F.substring("path", -n, 1).alias("data"))  # noqa: E731  a brand writes its second digit and reads its first
    return pipelines.parse_pipelines(declared, metas, module_io=(io(1), io(2)))


@register("s12_pipeline_members", f"with {_MEMBERS} select cast(pipeline as varchar) as pipeline, module_id from mem")
def _(spark, d):
    return membership(spark, d)[0]


@register("s12_pipeline_flow", f"with {_MEMBERS} select cast(x.pipeline as varchar) as pipeline, x.module_id as a, y.module_id as b, 'io_inferred' as derivation, 0.5::double as confidence from mem x join mem y on x.pipeline = y.pipeline and right(x.module_id, 1) = left(right(y.module_id, 2), 1) and x.module_id <> y.module_id")
def _(spark, d):
    return membership(spark, d)[1]


@register(
    "s15_containers",
    """with p as (select lower(replace(p_brand, '#', '-')) as pkg, p_partkey from part) select 'pkg:' || pkg as id, pkg as name, 'Package' as kind, null as package from p group by pkg
    union all select 'ctr:img/' || p_partkey, 'img/' || p_partkey, 'Container', 'pkg:' || pkg from p""",
)
def _(spark, d):
    p = star(spark, d, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("name"), F.concat(F.lit("img/"), text("p_partkey")).alias("image"), text("p_size").alias("v"))
    p = p.groupBy("name", "v").agg(F.collect_list(F.struct(F.col("image").alias("image_name"), F.lit("q").alias("registry"))).alias("images"))
    p = p.groupBy("name").agg(F.collect_list(F.struct(F.col("v").alias("meta_version"), "images")).alias("versions"))
    entity, rel = registry.parse_containers(spark, one_each(p.select(F.to_json(F.struct("name", "versions")).alias("value")), folder(spark, "containers")), ingested_at=DAY)
    return entity.join(rel.select(F.col("from_id").alias("id"), F.col("to_id").alias("package")), "id", "left").select("id", "name", "kind", "package")


@register("s16_registry_records", "select lower(replace(p_brand, '#', '-')) as registry_id, array_to_string(list_sort(list(distinct 'op:operation_' || p_size)), '|') as operations from part group by 1")
def _(spark, d):
    uri = lambda p: F.struct(F.concat(F.lit(f"http://e/{p}_"), text("p_size")).alias("uri"))
    p = star(spark, d, "part").groupBy(F.replace("p_brand", F.lit("#"), F.lit("-")).alias("biotoolsID")).agg(F.array_union(F.collect_set(uri("operation")), F.collect_set(uri("topic"))).alias("operation"))
    records = p.select(F.to_json(F.struct("biotoolsID", F.array(F.struct("operation")).alias("function"))).alias("value"))
    return registry.parse_registry(spark, one_each(records, folder(spark, "registry"))).withColumn("operations", F.array_join("operations", "|"))


@register(
    "s18_execution_specs",
    """with r as (select case when p_size = 50 then 'mod:gone' else 'mod:' || lower(replace(p_brand, '#', '')) end as module_id, lpad(cast(p_partkey as varchar), 9, '0') as path, case when p_size % 2 = 0 then 'img/' || p_size else '' end as image, case when p_size % 3 = 0 then 'http://s/' || p_size else '' end as web from part),
    x as (select *, coalesce(nullif(image, ''), web) as img from r where module_id <> 'mod:gone'), y as (select *, row_number() over (partition by module_id order by path) as k from x where img <> '')
    select replace(module_id, 'mod:', 'exec:') as spec_id, arg_min(image, path) as image, arg_min(web, path) as singularity, case when count(distinct img) > 1 then count(distinct img) else 0 end as n_variants from y group by module_id""",
)
def _(spark, d):
    size = F.col("p_size")
    r = star(spark, d, "part").select(
        F.when(size == 50, "mod:gone").otherwise(F.concat(F.lit("mod:"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))).alias("module_id"), F.lpad(text("p_partkey"), 9, "0").alias("path"),
        F.when(size % 2 == 0, F.concat(F.lit("img/"), text("p_size"))).otherwise("").alias("image"), F.when(size % 3 == 0, F.concat(F.lit("http://s/"), text("p_size"))).otherwise("").alias("singularity"),
    )
    specs, _ = recipes.build_specs(r, entities(spark, d, "Module"))
    return specs.select("spec_id", "image", "singularity", F.size("variants").cast("long").alias("n_variants"))


@register(
    "s20_skill_wiring",
    sql("""select distinct 'skill:' || p_type as skill_id, case when p_size <= 10 then 'm:1' else 'm:' || p_partkey end as method_id from part where p_size <= 10 or p_size > 40"""),
)
def _(spark, d):
    """Every type is a skill that declares its parts; small ones go by an alias, and those between are no methods."""
    size = F.col("p_size")
    tool = F.when(size <= 10, F.lit("One")).when(size > 40, text("p_partkey")).otherwise(F.concat(F.lit("none"), text("p_partkey")))
    s = star(spark, d, "part").select(F.concat(F.lit("skill:"), "p_type").alias("skill_id"), F.array(tool).alias("tools"))
    aliases = spark.createDataFrame([("one", "m:1")], "tool string, method_id string")
    return skills.wire_skills(s, entities(spark, d, "Method"), aliases)[0].select("skill_id", "method_id")


@register("s27_results", "select case when event_id % 2 = 0 then 'whole' else 'next' end as task, count(*) as n, count(*) filter (event_type <> 'error') as n_answered from events group by 1")
def _(spark, d):
    failed = F.col("event_type") == "error"
    rows = star(spark, d, "events").select(text("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "whole").otherwise("next").alias("task"), F.when(~failed, F.to_json(F.array("event_type"))).alias("raw"), F.when(failed, "failed").alias("error"))
    path = folder(spark, "results")
    rows.write.json(path)
    return runner.read_results(spark, path).groupBy("task").agg(F.count("*").alias("n"), F.count("raw").alias("n_answered"))


# ---- curated layers: files of one record per nation


def nations(spark: SparkSession, d: str) -> list[int]:
    return sorted(r[0] for r in star(spark, d, "nation").select("n_nationkey").collect())  # twenty-five, by the schema


def curated_file(spark: SparkSession, name: str, content: dict) -> dict:
    """Written and read again; JSON is YAML."""
    path = folder(spark, "curated")
    put(spark, f"{path}/{name}", json.dumps(content))
    return C.read_yaml(spark, path, name)


def emitted(parts: C.Emitted) -> DataFrame:
    """Edges, and what was left out with the reason, as one table."""
    _, rel, skipped = parts
    return rel.select("from_id", "to_id", "kind", "properties", F.lit("").alias("skipped")).unionByName(skipped.select("from_id", "to_id", F.lit("").alias("kind"), F.lit("").alias("properties"), "skipped"))


_LINK = """select {a} as from_id, {b} as to_id, case when {why} = '' then '{kind}' else '' end as kind,
  case when {why} = '' then '{{"basis": "curated", "confidence": ' || case when n_nationkey % 2 = 0 then '1.0' else '0.6' end || ', "evidence": "doi:10/' || n_nationkey || '"}}' else '' end as properties, {why} as skipped from nation"""


def _links(layer: str, start: str, end: str):
    about = C.LAYERS[layer]

    def run(spark: SparkSession, d: str) -> DataFrame:
        key = lambda p, n: "mod:brand11" if p == "wrong" else f"{p}{n}"
        records = [
            {about[1]: key("wrong" if n % 5 == 4 else start, n + 1) if n % 7 < 6 else "gone", about[2]: f"{end}{n + 1}" if n % 3 else "lost", "confidence": "high" if n % 2 == 0 else "low", "evidence": {"doi": f"10/{n}"}}
            for n in nations(spark, d)
        ]
        # a pair may come once only
        once = {(r[about[1]], r[about[2]], r["evidence"]["doi"]): r for r in records}
        links = [x for r in once.values() for x in C.load_links([r], *about[1:3])]
        curated_file(spark, about[0], {"links": list(once.values())})
        return emitted(C.emit_links(spark, layer, links, entities(spark, d), ingested_at=DAY))

    return run


def _links_sql(kind: str, start: str, end: str, word: str) -> str:
    a = f"case when n_nationkey % 7 >= 6 then 'gone' when n_nationkey % 5 = 4 then 'mod:brand11' else '{start}' || (n_nationkey + 1) end"
    b = f"case when n_nationkey % 3 <> 0 then '{end}' || (n_nationkey + 1) else 'lost' end"
    why = f"""case when {a} not in (select id from entity) then '{word}_missing' when {a} = 'mod:brand11' then '{word}_wrong_kind:Module' when {b} not in (select id from entity) then 'target_missing' else '' end"""
    return sql(_LINK.format(a=a, b=b, why=why, kind=kind))


register("c1_method_statistics", _links_sql("USES_STATISTICAL_METHOD", "m:", "stat:", "method"))(_links("method_statistics", "m:", "stat:"))


@register(
    "c4_assumptions",
    sql("""select 'assum:new' || n_nationkey as id, 'Assumption' as kind, 'N' || n_nationkey as name from nation where n_nationkey % 2 = 0 and 'stat:' || (n_nationkey + 1) in (select id from entity) union all
    select 'stat:' || (n_nationkey + 1) || '>' || case when n_nationkey % 2 = 0 then 'assum:new' || n_nationkey else 'assum:' || n_nationkey end, 'REQUIRES_ASSUMPTION', '' from nation where 'stat:' || (n_nationkey + 1) in (select id from entity) union all
    select 'stat:' || (n_nationkey + 1) || '>' || case when n_nationkey % 2 = 0 then 'assum:new' || n_nationkey else 'assum:' || n_nationkey end, 'method_missing', '' from nation where 'stat:' || (n_nationkey + 1) not in (select id from entity)"""),
)
def _(spark, d):
    """Requirements of statistics; every second assumption is new to the graph."""
    key = lambda n: f"assum:new{n}" if n % 2 == 0 else f"assum:{n}"
    ns = nations(spark, d)
    doc = {"assumptions": [{"id": key(n), "name": f"N{n}"} for n in ns], "requires": [{"statistical_method": f"stat:{n + 1}", "assumption": key(n), "evidence": f"doi:10/{n}"} for n in ns]}
    _, vocabulary, links = C.load_assumptions(curated_file(spark, C.ASSUMPTIONS, doc))
    e, rel, skipped = C.emit_assumptions(spark, vocabulary, links, entities(spark, d), ingested_at=DAY)
    ends = F.concat("from_id", F.lit(">"), "to_id").alias("id")
    return e.select("id", "kind", "name").union(rel.select(ends, "kind", F.lit(""))).union(skipped.select(ends, "skipped", F.lit("")))


@register(
    "c5_diagnostics",
    sql("""select 'diag:d' || n_nationkey as id, '{' || case when n_nationkey % 3 <> 0 then '"applies_to_assumption": "assum:' || n_nationkey || '", ' else '' end || '"checkable": "pre_run", "form": "test", "how": "", "min_replicates_per_group": ' || (n_nationkey + 1) || '}' as properties,
    'assum:' || n_nationkey as checks, case when n_nationkey % 2 = 0 then 'assum:gone' else '' end as skipped from nation"""),
)
def _(spark, d):
    """Diagnostics of one assumption each; every second one also names an assumption that isn't there."""
    doc = {"diagnostics": {f"d{n}": {"name": f"D{n}", "checks": [str(n), *(["gone"] if n % 2 == 0 else [])], "ref": f"doi:10/{n}", "checkable": "pre_run", "min_replicates_per_group": n + 1} | ({"applies_to_assumption": str(n)} if n % 3 else {}) for n in nations(spark, d)}}
    e, rel, skipped = C.emit_diagnostics(spark, C.load_diagnostics(curated_file(spark, C.DIAGNOSTICS, doc)), entities(spark, d), ingested_at=DAY)
    x = e.select("id", "properties").join(rel.select(F.col("to_id").alias("id"), F.col("from_id").alias("checks")), "id")
    return x.join(skipped.select(F.col("to_id").alias("id"), F.col("from_id").alias("gone")), "id", "left").select("id", "properties", "checks", F.coalesce("gone", F.lit("")).alias("skipped"))


@register(
    "c6_tool_io",
    sql("""select 'm:' || (n_nationkey + 1) as from_id, 'data:' || (n_nationkey % 7) as to_id, case when n_nationkey % 7 < 5 then 'INPUT' else '' end as kind, case when n_nationkey % 7 < 5 then '{"basis": "curated"}' else '' end as properties, case when n_nationkey % 7 < 5 then '' else 'data_missing' end as skipped from nation union all
    select 'm:' || (n_nationkey + 1), 'data:0', 'OUTPUT', '{"basis": "curated"}', '' from nation"""),
)
def _(spark, d):
    doc = {"data_types": {f"t{k}": {"edam": str(k)} for k in range(7)}, "tool_io": {str(n + 1): {"consumes": [f"t{n % 7}"], "produces": ["t0"]} for n in nations(spark, d)}}
    return emitted(C.emit_tool_io(spark, C.load_tool_io(curated_file(spark, C.DATA_TYPES, doc)), entities(spark, d), ingested_at=DAY))


@register(
    "c7_operation_edits",
    sql("""select 'm:' || (n_nationkey + 1) as from_id, 'op:gone' as to_id, '' as kind, '' as properties, 'operation_missing' as skipped from nation union all
    select 'm:' || (n_nationkey + 1), (select min(id) from entity where kind = 'Operation'), 'PERFORMS', '{"basis": "curated"}', '' from nation"""),
)
def _(spark, d):
    entity = entities(spark, d)
    first = entity.where("kind = 'Operation'").agg(F.min("id")).first()[0]
    doc = {"methods": {str(n + 1): {"add": ["gone", first]} for n in nations(spark, d)}}
    added, _ = C.load_operation_edits(curated_file(spark, C.OPERATIONS, doc))
    return emitted(C.emit_operation_edits(spark, added, entity, ingested_at=DAY))


@register(
    "c8_modalities",
    sql("""select 'pipe:' || n_nationkey as from_id, 'modality:k' || (n_nationkey % 4) as to_id, case when 'pipe:' || n_nationkey in (select id from entity) then 'HAS_MODALITY' else '' end as kind,
    case when 'pipe:' || n_nationkey in (select id from entity) then '{"basis": "curated"}' else '' end as properties, case when 'pipe:' || n_nationkey in (select id from entity) then '' else 'pipeline_missing' end as skipped from nation"""),
)
def _(spark, d):
    doc = {"modalities": {f"k{k}": {"name": f"K{k}"} for k in range(4)}, "pipelines": {str(n): [f"k{n % 4}"] for n in nations(spark, d)}}
    return emitted(C.emit_modalities(spark, *C.load_modalities(curated_file(spark, C.MODALITIES, doc)), entities(spark, d), ingested_at=DAY))


@register(
    "d23_causal_triage",
    sql_with(
        "hy as (select 'h' || n_nationkey as hypothesis, case n_nationkey % 3 when 0 then 'descriptive' when 1 then 'interventional' else 'observational' end as design, case when n_nationkey % 4 = 0 then null else 'm:' || (n_nationkey + 1) end as method_id from nation)",
        """select hypothesis, design, hy.method_id, case design when 'descriptive' then 'DESCRIPTIVE' when 'interventional' then 'IDENTIFIED' else 'NOT IDENTIFIABLE' end as claim, coalesce(hy.method_id in (select id from entity), false) as found,
    coalesce((select string_agg(distinct e.name, '|' order by e.name) from rel r join entity e on e.id = r.to_id where r.kind = 'PERFORMS' and r.from_id = hy.method_id), '') as operations,
    coalesce((select string_agg(distinct e.name, '|' order by e.name) from rel r join entity e on e.id = r.to_id where r.kind = 'USES_STATISTICAL_METHOD' and r.from_id = hy.method_id), '') as statistics from hy""",
    ),
)
def _(spark, d):
    n = F.col("n_nationkey")
    h = star(spark, d, "nation").select(
        F.concat(F.lit("h"), text("n_nationkey")).alias("hypothesis"), F.when(n % 3 == 0, "descriptive").when(n % 3 == 1, "interventional").otherwise("observational").alias("design"),
        F.when(n % 4 != 0, F.concat(F.lit("m:"), (n + 1).cast("string"))).alias("method_id"),
    )
    t = triage.ground(h, *graph(spark, d, nodes=["Method", "Operation", "Container", "Data", "StatisticalMethod", "Assumption"], edges=[*T.BUCKETS.values(), "REQUIRES_ASSUMPTION", "AMENABLE_TO"]))
    return t.select("hypothesis", "design", "method_id", "claim", "found", F.array_join("operations", "|").alias("operations"), F.array_join("statistics", "|").alias("statistics"))
