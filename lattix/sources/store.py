"""The graph store: entities and relations as Parquet, both partitioned by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.operators.traverse import without_dangling
from lattix.schema import ENTITY, ENTITY_COLUMNS, REL, REL_COLUMNS


def normalised(df: DataFrame, columns: list[str], *, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The table's columns in order, as strings, with empty strings for what is missing, and the further ones to ``keep``."""
    have = set(df.columns)
    return df.select(*((F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in columns), *keep)


def write_graph(entity: DataFrame, rel: DataFrame, path: str, *, drop_dangling: bool = True) -> dict[str, int] | None:
    """Write a graph over whatever was there.  Relations with a missing end are dropped and counted:
    {nodes, edges_loaded, edges_dropped}; without ``drop_dangling`` nothing is checked or counted."""
    entity, rel = normalised(entity, ENTITY_COLUMNS), normalised(rel, REL_COLUMNS)
    kept = without_dangling(entity, rel) if drop_dangling else rel
    for df, name in ((entity, "entity"), (kept, "rel")):
        df.hint("rebalance", "kind").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/{name}")
    if not drop_dangling:
        return None
    e, r = read_graph(entity.sparkSession, path)
    nodes, loaded = e.count(), r.count()
    return {"nodes": nodes, "edges_loaded": loaded, "edges_dropped": rel.count() - loaded}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entity, rel) of a written graph; a filter on kind reads only that kind's files."""
    entity = spark.read.schema(ENTITY).parquet(f"{path}/entity").select(ENTITY_COLUMNS)
    return entity, spark.read.schema(REL).parquet(f"{path}/rel").select(REL_COLUMNS)
