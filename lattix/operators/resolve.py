"""Entity resolution: merging records of one id, candidate pairs of ids, first-wins removal of repeats.

Tables have no order, so records carry ``src_ord``, the place where they were first met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattix.operators.traverse import of_kind
from lattix.plans.runtime import spread_join

# How sure a shared registry id or name makes, and the largest group that is paired.
BY_REGISTRY, BY_NAME, LARGEST_GROUP = 0.7, 0.5, 8


def hard_merge(records: DataFrame) -> DataFrame:
    """One row per id.  Records are ordered by their properties; the first is canonical, and what it lacks (a column, or
    a key of ``props``, a map) comes from the next that has it."""
    rank = Window.partitionBy("id").orderBy(F.to_json("props"), "src_ord")
    r = records.withColumn("rank", F.row_number().over(rank))
    scalars = [c for c in records.columns if c not in ("id", "props", "src_ord")]
    filled = r.groupBy("id").agg(
        *(F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("rank"))), F.min_by(c, "rank")).alias(c) for c in scalars), F.count("*").alias("n_records")
    )
    entries = r.select("id", "rank", F.explode_outer("props").alias("k", "v")).where("k is not null").groupBy("id", "k").agg(F.min_by("v", "rank").alias("v"))
    props = entries.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return filled.join(props, "id", "left")


def pairs_sharing(records: DataFrame, key, confidence: float, basis: str, largest: int = LARGEST_GROUP) -> DataFrame:
    """(from_id, to_id, confidence, basis) of ids that share a key; groups beyond ``largest`` are left out (they are
    listed by ``large_groups``), so pairs are at most that many times the records."""
    x = records.select("id", F.lower(key).alias("key")).where("key is not null and key <> ''").distinct()
    sized = x.join(x.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, largest)).select("key"), "key")
    a, b = sized.select("key", F.col("id").alias("from_id")), sized.select("key", F.col("id").alias("to_id"))
    return a.join(b, "key").where("from_id < to_id").select("from_id", "to_id", F.lit(confidence).alias("confidence"), F.lit(basis).alias("basis"))


def large_groups(records: DataFrame, key, largest: int = LARGEST_GROUP) -> DataFrame:
    x = records.select("id", F.lower(key).alias("key")).where("key is not null and key <> ''").distinct()
    return x.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > largest)


def same_as(methods: DataFrame, largest: int = LARGEST_GROUP) -> DataFrame:
    """Candidate pairs by registry id and by name; of a pair that both give, the surer."""
    both = pairs_sharing(methods, F.col("biotools_id"), BY_REGISTRY, "biotools_id", largest).unionByName(pairs_sharing(methods, F.col("name"), BY_NAME, "name", largest))
    best = both.groupBy("from_id", "to_id").agg(F.max(F.struct("confidence", "basis")).alias("b"))
    return best.select("from_id", "to_id", "b.confidence", "b.basis")


def first_wins(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row, by ``src_ord``, of every key."""
    w = Window.partitionBy(*keys).orderBy("src_ord")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def packaged_as(entity: DataFrame, rel: DataFrame) -> DataFrame:
    """(from_id, to_id): a method is packaged as every container of its package, or the package if that has none.  The
    targets of a package name are made distinct before the methods come in; only methods with several names are so afterwards."""
    packages = of_kind(entity, "Package").select(F.col("id").alias("package_id"), F.lower("name").alias("pkg")).where("pkg <> ''")
    methods = of_kind(entity, "Method").where("bioconda_pkg <> ''").select(F.col("id").alias("from_id"), F.lower("bioconda_pkg").alias("pkg"))
    containers = of_kind(rel, "FROM_PACKAGE").select(F.col("from_id").alias("container_id"), F.col("to_id").alias("package_id")).distinct()
    targets = packages.join(containers, "package_id", "left").select("pkg", F.coalesce("container_id", "package_id").alias("to_id")).distinct()
    methods = methods.distinct()
    named = methods.groupBy("from_id").agg(F.count("*").alias("n"), F.min("pkg").alias("pkg"))
    one = spread_join(named.where("n = 1").select("from_id", "pkg"), targets, "pkg").select("from_id", "to_id")
    more = methods.join(named.where("n > 1").select("from_id"), "from_id", "left_semi").join(targets, "pkg")
    return one.unionByName(more.select("from_id", "to_id").distinct())


def merge_attestations(edges: DataFrame) -> DataFrame:
    """(from_id, to_id, pipelines, confidence, derivation, src_ord) rows to one per pair: all pipelines, how many they are,
    the highest confidence, and the derivation of the first."""
    one = edges.select("from_id", "to_id", F.explode_outer("pipelines").alias("p"), "confidence", "derivation", "src_ord")
    return one.groupBy("from_id", "to_id").agg(
        F.array_sort(F.collect_set("p")).alias("pipelines"), F.count_distinct("p").alias("attestations"), F.max("confidence").alias("confidence"), F.min_by("derivation", "src_ord").alias("derivation")
    )


def registry_edges(methods: DataFrame, records: DataFrame, performs: DataFrame) -> DataFrame:
    """New (from_id, to_id) operations of methods by their registry id; ``records`` holds (registry_id, operations)."""
    m = methods.select(F.col("id").alias("from_id"), F.lower(F.trim("biotools_id")).alias("registry_id")).where("registry_id <> ''")
    r = records.select(F.lower(F.trim("registry_id")).alias("registry_id"), F.explode("operations").alias("to_id")).distinct()
    return m.join(r, "registry_id").select("from_id", "to_id").distinct().join(performs.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


def ground_links(links: DataFrame, entity: DataFrame, from_kind: str, to_kind: str) -> DataFrame:
    """The links with a ``skipped`` reason, null where both ends exist and are of the right kind."""
    a = entity.select(F.col("id").alias("from_id"), F.col("kind").alias("__a"))
    b = entity.select(F.col("id").alias("to_id"), F.col("kind").alias("__b"))
    x = links.join(a, "from_id", "left").join(b, "to_id", "left")
    reason = (
        F.when(F.col("__a").isNull(), F.lit("from_missing"))
        .when(F.col("__a") != from_kind, F.concat(F.lit("from_wrong_kind:"), "__a"))
        .when(F.col("__b").isNull(), F.lit("to_missing"))
        .when(F.col("__b") != to_kind, F.concat(F.lit("to_wrong_kind:"), "__b"))
    )
    return x.withColumn("skipped", reason).drop("__a", "__b")
