"""Building a graph: read sources, merge, resolve, enrich, store, audit, lock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions.canon import from_raw_values, properties, raw_values
from lattix.graph import PropertyGraph
from lattix.operators import resolve
from lattix.operators.traverse import of_kind, without_edges
from lattix.plans.runtime import cut
from lattix.schema import ENTITY_COLUMNS, REL_COLUMNS
from lattix.sources.curated import emit_all
from lattix.sources.manifest import write_lock
from lattix.sources.skills import read_skills, wire_skills
from lattix.sources.store import normalised


def gather(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """All parts' tables with ``src_ord``, the order of their sources: the part, the file, the place in the file where a reader
    gives one (``src_pos``, path and position), and the content for what is still equal."""

    def tag(df: DataFrame, cols: list[str], k: int) -> DataFrame:
        at = F.col("src_pos") if "src_pos" in df.columns else F.struct(F.col("source_url").alias("path"), F.lit(0).alias("pos"))
        rows = df.select("*", at.alias("__at")) if "source_url" in df.columns or "src_pos" in df.columns else df.withColumn("__at", F.struct(F.lit("").alias("path"), F.lit(0).alias("pos")))
        return normalised(rows, cols, keep=["__at"]).withColumn("src_ord", F.struct(F.lit(k).alias("part"), "__at.path", "__at.pos", *cols)).drop("__at")

    entity = reduce(DataFrame.unionByName, (tag(e, ENTITY_COLUMNS, k) for k, (e, _) in enumerate(parts)))
    rel = reduce(DataFrame.unionByName, (tag(r, REL_COLUMNS, k) for k, (_, r) in enumerate(parts)))
    return entity, rel


def merge_flow(rel: DataFrame) -> DataFrame:
    """Relations with one DOWNSTREAM_OF per pair, attested by all its pipelines; it keeps what else the first one says."""
    flow = of_kind(rel, "DOWNSTREAM_OF")
    p = lambda k: F.get_json_object("properties", f"$.{k}")
    merged = resolve.merge_attestations(flow.select("from_id", "to_id", F.from_json(p("pipelines"), "array<string>").alias("pipelines"), p("confidence").cast("double").alias("confidence"), p("derivation").alias("derivation"), "src_ord"))
    values = F.to_json(F.struct("attestations", "confidence", "derivation", "pipelines"))
    merged = merged.select("from_id", "to_id", raw_values(values).alias("merged"))
    first = resolve.first_wins(flow, "from_id", "to_id").withColumn("own", F.coalesce(raw_values(F.col("properties")), F.expr("cast(map() as map<string,string>)"))).drop("properties")
    out = first.join(merged, ["from_id", "to_id"])
    kept = F.map_filter("own", lambda k, _: ~F.map_contains_key("merged", k))
    out = out.withColumn("properties", from_raw_values(F.map_concat(kept, "merged")))
    return rel.where("kind <> 'DOWNSTREAM_OF'").unionByName(out.select(rel.columns))


def resolve_graph(entity: DataFrame, rel: DataFrame, *, ingested_at: str) -> tuple[DataFrame, DataFrame]:
    """One row per id, candidate equivalences, first-wins relations, packages."""
    methods = of_kind(entity, "Method").withColumn("props", raw_values(F.col("properties"))).drop("properties", "kind")
    empty = F.expr("cast(map() as map<string,string>)")
    merged = resolve.hard_merge(methods).withColumn("kind", F.lit("Method")).withColumn("properties", from_raw_values(F.coalesce("props", empty)))
    others = resolve.first_wins(entity.where("kind <> 'Method'"), "id")
    entity = cut(normalised(merged, ENTITY_COLUMNS).unionByName(normalised(others, ENTITY_COLUMNS)))
    rel = resolve.first_wins(merge_flow(rel), "from_id", "to_id", "kind")
    tail = [F.lit("resolver").alias("source"), F.lit("derived").alias("source_url"), F.lit(ingested_at).alias("ingested_at")]
    same = resolve.same_as(of_kind(entity, "Method"))
    props = properties(basis=F.col("basis"), confidence=F.col("confidence"))
    same = same.select("from_id", "to_id", F.lit("SAME_AS").alias("kind"), props.alias("properties"), *tail)
    packed = resolve.packaged_as(entity, rel).select("from_id", "to_id", F.lit("PACKAGED_AS").alias("kind"), F.lit("{}").alias("properties"), *tail)
    return entity, cut(normalised(rel, REL_COLUMNS).unionByName(same).unionByName(packed))


def enrich(entity: DataFrame, rel: DataFrame, *, registry: DataFrame | None = None, added: DataFrame | None = None, removed: DataFrame | None = None, ingested_at: str) -> DataFrame:
    """Relations with operations from the registry, then with curated additions, then without curated removals."""
    tail = [F.lit("PERFORMS").alias("kind"), F.lit("{}").alias("properties"), F.lit("enrichment").alias("source"), F.lit("derived").alias("source_url"), F.lit(ingested_at).alias("ingested_at")]
    operations = of_kind(entity, "Operation").select(F.col("id").alias("to_id"))
    for more in (resolve.registry_edges(of_kind(entity, "Method"), registry, of_kind(rel, "PERFORMS")) if registry is not None else None, added):
        if more is not None:
            new = more.join(operations, "to_id", "left_semi").select("from_id", "to_id").distinct()
            new = new.join(of_kind(rel, "PERFORMS").select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
            rel = rel.unionByName(new.select("from_id", "to_id", *tail))
    return without_edges(rel, removed.withColumn("kind", F.lit("PERFORMS"))) if removed is not None else rel


def with_skills(spark, entity: DataFrame, rel: DataFrame, root: str, *, ingested_at: str) -> tuple[DataFrame, DataFrame]:
    """The graph with the skills below a folder, each wrapping the methods that it declares.  The words that prose is searched
    for are the methods' names, of which a build has some thousand."""
    library = root.rstrip("/").rsplit("/", 1)[-1]
    methods = of_kind(entity, "Method")
    found = cut(read_skills(spark, root, {r[0] for r in methods.select(F.lower("name")).distinct().collect()}, library=library))
    wraps, _ = wire_skills(found, methods)
    tail = [F.lit(library).alias("source"), F.lit(root).alias("source_url"), F.lit(ingested_at).alias("ingested_at")]
    nodes = found.select(F.col("skill_id").alias("id"), "name", F.lit("Skill").alias("kind"), "properties", F.lit("").alias("bioconda_pkg"), F.lit("").alias("biotools_id"), *tail)
    edges = wraps.select(F.col("skill_id").alias("from_id"), F.col("method_id").alias("to_id"), F.lit("WRAPS").alias("kind"), properties(tool=F.col("tool"), via=F.col("via")).alias("properties"), *tail)
    return entity.unionByName(nodes.dropDuplicates(["id"])), rel.unionByName(edges)


def build(spark, parts: list[tuple[DataFrame, DataFrame]], path: str, *, ingested_at: str, lock: str | None = None, curated: str | None = None, skills: str | None = None, **enrichment) -> dict:
    """Build, store, audit and lock a graph from sources' tables, with the curated files and the skills of folders; the report
    holds counts, the fingerprint and failures."""
    entity, rel = resolve_graph(*gather(parts), ingested_at=ingested_at)
    if curated:
        nodes, links, _, removed = emit_all(spark, curated, entity, ingested_at=ingested_at)
        nodes, links = cut(nodes), cut(links)
        entity = entity.unionByName(nodes)
        enrichment["removed"] = removed if enrichment.get("removed") is None else enrichment["removed"].unionByName(removed)
        key = ["from_id", "to_id", "kind"]
        rel = rel.unionByName(links.select(rel.columns).dropDuplicates(key).join(rel.select(*key), key, "left_anti").select(rel.columns))
    rel = enrich(entity, rel, ingested_at=ingested_at, **enrichment)
    if skills:
        entity, rel = with_skills(spark, entity, rel, skills, ingested_at=ingested_at)
    counts = PropertyGraph(spark, entity, rel).save(path)
    graph = PropertyGraph.open(spark, path)
    failures = {r["name"]: r["violations"] for r in graph.audit().where("not ok").collect()}
    report = {**counts, "fingerprint": graph.fingerprint(runs=True), "failures": failures, "ingested_at": ingested_at}
    if lock:
        write_lock(lock, report)
    return report
