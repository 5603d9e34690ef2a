"""Filters, traversals and lookups over the entity and relation tables.

Every function takes and returns DataFrames and works on all seeds, keywords or methods at once; what the caller wants
of one node is a filter on the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.plans.runtime import cut, spread_join


def of_kind(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("kind") == kinds[0]) if len(kinds) == 1 else df.where(F.col("kind").isin(*kinds))


def members(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose ``column`` is among ``ids.id``."""
    return df.join(ids.select(F.col("id").alias("__member")).distinct(), F.col(column) == F.col("__member"), "left_semi")


def missing_provenance(df: DataFrame) -> DataFrame:
    """Rows with an empty or null source, source url or ingestion date."""
    bad = F.lit(False)
    for c in ("source", "source_url", "ingested_at"):
        bad |= F.col(c).isNull() | (F.col(c) == "")
    return df.where(bad)


def without_edges(rel: DataFrame, remove: DataFrame) -> DataFrame:
    """Relations whose (from_id, to_id, kind) is not listed."""
    return rel.join(remove.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti").select(rel.columns)


def matches(keyword: Column, *, values_only: bool = False) -> Column:
    """Case-insensitive containment in the name or the properties text.  The text holds property names too;
    ``values_only`` leaves them out."""
    props = F.regexp_replace("properties", r'"[^"]*": ', "") if values_only else F.col("properties")
    return F.contains(F.lower("name"), F.lower(keyword)) | F.contains(F.lower(props), F.lower(keyword))


def with_all_keywords(entity: DataFrame, keywords: list[str]) -> DataFrame:
    """Entities whose name and description hold every keyword; none for an empty list."""
    if not keywords:
        return entity.limit(0)
    text = F.lower(F.concat_ws(" ", "name", F.get_json_object("properties", "$.description")))
    hit = F.lit(True)
    for k in keywords:
        hit &= F.contains(text, F.lit(k.lower()))
    return entity.where(hit)


def endpoints(rel: DataFrame, entity: DataFrame) -> DataFrame:
    """Relations with the kinds and names of both ends; ends that don't exist are null."""
    a = entity.select(F.col("id").alias("from_id"), F.col("kind").alias("from_kind"), F.col("name").alias("from_name"))
    b = entity.select(F.col("id").alias("to_id"), F.col("kind").alias("to_kind"), F.col("name").alias("to_name"))
    return rel.join(a, "from_id", "left").join(b, "to_id", "left")


def without_dangling(entity: DataFrame, rel: DataFrame) -> DataFrame:
    """Relations both of whose ends exist."""
    return members(members(rel, "from_id", entity), "to_id", entity)


def undirected(rel: DataFrame) -> DataFrame:
    return rel.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).unionByName(rel.select(F.col("to_id").alias("a"), F.col("from_id").alias("b")))


def within_hops(entity: DataFrame, rel: DataFrame, seeds: DataFrame, k: int = 1) -> DataFrame:
    """(id, hop) of the seeds that exist and all nodes at most ``k`` undirected steps away.  Each round joins only the
    last frontier and drops what was seen; a frontier that a further round asks for is cut from its lineage, and so is the third."""
    both = undirected(rel)
    seen = members(entity.select("id"), "id", seeds).distinct().select("id", F.lit(0).alias("hop"))
    frontier = seen
    for hop in range(1, max(1, k) + 1):
        found = both.join(frontier.select("id"), both["a"] == frontier["id"], "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = found.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"))
        if hop < k or hop >= 3:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen


def seed_subgraph(entity: DataFrame, rel: DataFrame, seeds: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """The nodes within ``k`` hops of the seeds and all edges among them, parallel ones included."""
    ids = within_hops(entity, rel, seeds, k).select("id")
    return members(entity, "id", ids), members(members(rel, "from_id", ids), "to_id", ids).select("from_id", "to_id", "kind")


def reach(rel: DataFrame, seeds: DataFrame, hops: int, kinds: list[str]) -> DataFrame:
    """(id, hop) reached along edges of some kinds within a number of hops, each at its least: a recursive query."""
    spark = rel.sparkSession
    edges = of_kind(rel, *kinds).select("from_id", "to_id")
    sql = f"""
      with recursive walk(id, hop) as (
        select id, 0 from {{seeds}} union all
        select e.to_id, hop + 1 from walk join {{edges}} e on walk.id = e.from_id where hop < {int(hops)})
      select id, min(hop) as hop from walk group by id"""
    return spark.sql(sql, seeds=seeds.select("id").distinct(), edges=edges)


def resolve_keywords(entity: DataFrame, rel: DataFrame, keywords: list[str]) -> DataFrame:
    """(ord, id): for each keyword in turn the methods that match, the methods with a path of one or two steps to another
    match, and the assumptions that match, each by id; an id counts where it comes first."""
    words = entity.sparkSession.createDataFrame(list(enumerate(keywords)), "kw int, word string")
    hit = entity.join(F.broadcast(words), matches(F.col("word"))).select("kw", "id", "kind")
    one = of_kind(hit, "Method").select("kw", F.lit(0).alias("branch"), "id")
    three = of_kind(hit, "Assumption").select("kw", F.lit(2).alias("branch"), "id")
    edges = rel.select("from_id", "to_id")
    other = hit.where("kind <> 'Method'").select("kw", F.col("id").alias("to_id")).distinct()
    step1 = edges.join(other, "to_id").select("kw", "from_id").distinct()
    step2 = edges.join(step1.select("kw", F.col("from_id").alias("to_id")), "to_id").select("kw", "from_id").distinct()
    near = members(step1.unionByName(step2).distinct(), "from_id", of_kind(entity, "Method"))
    two = near.select("kw", F.lit(1).alias("branch"), F.col("from_id").alias("id"))
    every = one.unionByName(two).unionByName(three)
    first = every.groupBy("id").agg(F.min(F.struct("kw", "branch")).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at.kw", "at.branch", "id")).alias("ord"), "id")


BUCKETS = {"operations": "PERFORMS", "packages": "PACKAGED_AS", "inputs": "INPUT", "outputs": "OUTPUT", "statistics": "USES_STATISTICAL_METHOD"}


def neighbourhood(entity: DataFrame, rel: DataFrame, *, direct: bool = False, buckets: tuple[str, ...] = tuple(BUCKETS)) -> DataFrame:
    """(method_id, bucket, id, name, via, evidence) of every method: what it performs, is packaged as, reads and writes,
    its statistics with their evidence, and, unless only ``direct`` neighbours are asked for, the assumptions they bring
    and the statistics that its operations allow.  What comes by several ways is listed once, with all the names it came
    through.  Of the direct neighbours, only some ``buckets`` may be asked for.  Names and evidence of the allowed statistics are put together by operation; a method with one operation
    takes them over as they are, dealt over all tasks, and only those with several are grouped."""
    evidence = F.coalesce(F.get_json_object("properties", "$.evidence"), F.lit(""))
    names = entity.select("id", "name")
    method = of_kind(entity, "Method").select(F.col("id").alias("method_id"))

    def hop(kind: str, a: str, b: str) -> DataFrame:
        return of_kind(rel, kind).select(F.col("from_id").alias(a), F.col("to_id").alias(b), evidence.alias("evidence"))

    cols = ["method_id", "bucket", "id", "name", "via", "evidence"]
    bucket = F.lit(None).cast("string")
    for b, kind in BUCKETS.items():
        bucket = F.when(F.col("kind") == kind, b).otherwise(bucket)
    shown = F.when(F.col("kind") == "USES_STATISTICAL_METHOD", evidence).otherwise("")
    near = of_kind(rel, *(BUCKETS[b] for b in buckets)).select(F.col("from_id").alias("method_id"), bucket.alias("bucket"), F.col("to_id").alias("id"), shown.alias("evidence"))
    near = near.join(method, "method_id", "left_semi")
    plain = near.where("bucket <> 'statistics'").distinct()
    near = plain.unionByName(near.where("bucket = 'statistics'").groupBy("method_id", "bucket", "id").agg(F.max("evidence").alias("evidence"))) if "statistics" in buckets else plain
    near = near.join(names, "id")
    near = near.withColumn("via", F.lit("")).select(cols)
    if direct:
        return near
    via = lambda: F.array_join(F.array_sort(F.collect_set(F.nullif("via", F.lit("")))), "|").alias("via")
    listed = lambda df, b: df.groupBy("method_id", "id", "name").agg(via(), F.max("evidence").alias("evidence")).withColumn("bucket", F.lit(b)).select(cols)
    stat = names.select(F.col("id").alias("stat"), F.col("name").alias("via"))
    uses = hop("USES_STATISTICAL_METHOD", "method_id", "stat").select("method_id", "stat").distinct().join(method, "method_id", "left_semi")
    used = uses.join(hop("REQUIRES_ASSUMPTION", "stat", "id").join(stat, "stat").join(names, "id"), "stat")
    performs = hop("PERFORMS", "method_id", "op").select("method_id", "op").distinct().join(method, "method_id", "left_semi")
    several = performs.groupBy("method_id").agg(F.count("*").alias("n_ops"), F.min("op").alias("op"))
    op = names.select(F.col("id").alias("op"), F.col("name").alias("via"))
    allowed = hop("AMENABLE_TO", "op", "id").groupBy("op", "id").agg(F.max("evidence").alias("evidence")).join(op, "op").join(names, "id")
    one = spread_join(several.where("n_ops = 1").select("method_id", "op"), allowed, "op").withColumn("bucket", F.lit("amenable")).select(cols)
    more = performs.join(several.where("n_ops > 1").select("method_id"), "method_id", "left_semi").join(allowed, "op")
    return near.unionByName(listed(used, "assumptions")).unionByName(one).unionByName(listed(more, "amenable"))


def skill_methods(rel: DataFrame) -> DataFrame:
    """(skill_id, ord, method_id): the methods that a skill wraps, by id."""
    wraps = of_kind(rel, "WRAPS").where(F.col("from_id").startswith("skill:")).select(F.col("from_id").alias("skill_id"), F.col("to_id").alias("method_id")).distinct()
    return wraps.withColumn("ord", F.row_number().over(Window.partitionBy("skill_id").orderBy("method_id")))


def context_text(entity: DataFrame, rel: DataFrame, seeds: DataFrame, k: int = 1) -> DataFrame:
    """(ord, line): the subgraph around the seeds as text, entities before relations."""
    nodes, edges = seed_subgraph(entity, rel, seeds, k)
    shown = F.when(F.col("properties").isin("", "{}"), F.concat("kind", F.lit(": "), "name")).otherwise(F.concat("kind", F.lit(": "), "name", F.lit(" "), "properties"))
    lines = nodes.select(F.lit(0).alias("part"), F.col("id").alias("k1"), F.lit("").alias("k2"), F.lit("").alias("k3"), shown.alias("line"))
    e = endpoints(edges, nodes)
    said = F.concat("from_name", F.lit(" -["), "kind", F.lit("]-> "), "to_name")
    lines = lines.unionByName(e.select(F.lit(1).alias("part"), F.col("from_id").alias("k1"), F.col("kind").alias("k2"), F.col("to_id").alias("k3"), said.alias("line")))
    return lines.select(F.row_number().over(Window.orderBy("part", "k1", "k2", "k3")).alias("ord"), "line")
