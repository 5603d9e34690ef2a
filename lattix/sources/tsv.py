"""Ontology tables: tab-separated classes with labels, parents and synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions.canon import properties
from lattix.functions.text import uri_id

# The columns of the file, and the kinds by the prefix of a class's local name.
REQUIRED = ["Class ID", "Preferred Label", "Parents", "Obsolete"]
KINDS = {"op:": "Operation", "data:": "Data", "fmt:": "Format"}


def parse_ontology_table(spark: SparkSession, path: str, *, ingested_at: str, source: str = "ontology") -> tuple[DataFrame, DataFrame]:
    """(entity, rel): classes that aren't obsolete and have a label, and IS_A to each parent that was kept.  A missing column
    is an error, unless the file has no rows."""
    raw = spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").csv(path)
    if lacking := [c for c in REQUIRED if c not in raw.columns]:
        if not raw.isEmpty():
            raise ValueError(f"missing columns: {', '.join(lacking)}")
        raw = raw.select("*", *(F.lit(None).cast("string").alias(c) for c in lacking))
    syn = F.col("Synonyms") if "Synonyms" in raw.columns else F.lit(None).cast("string")
    rows = raw.select(F.col("Class ID").alias("uri"), F.trim("Preferred Label").alias("name"), F.col("Parents").alias("parents"), F.upper(F.trim("Obsolete")).alias("gone"), syn.alias("syn"))
    kind = F.lit(None).cast("string")
    for prefix, k in KINDS.items():
        kind = F.when(F.col("id").startswith(prefix), k).otherwise(kind)
    kept = rows.withColumn("id", uri_id(F.col("uri"))).withColumn("kind", kind).where("kind is not null and coalesce(gone, '') <> 'TRUE' and coalesce(name, '') <> ''")
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("syn", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")))
    props = properties(uri=F.col("uri"), synonyms=F.when(F.size(names) > 0, names))
    tail = [F.lit(source).alias("source"), F.col("uri").alias("source_url"), F.lit(ingested_at).alias("ingested_at")]
    entity = kept.select("id", "name", "kind", props.alias("properties"), F.lit("").alias("bioconda_pkg"), F.lit("").alias("biotools_id"), *tail)
    up = kept.select("id", "uri", F.explode(F.split(F.coalesce("parents", F.lit("")), r"\s+")).alias("parent")).where("parent <> ''")
    up = up.withColumn("to_id", uri_id(F.col("parent"))).join(kept.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
    rel = up.select(F.col("id").alias("from_id"), "to_id", F.lit("IS_A").alias("kind"), F.lit("{}").alias("properties"), *tail).distinct()
    return entity, rel
