"""Container and registry records in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions.text import uri_id

CONTAINER = "name string, versions array<struct<meta_version string, images array<struct<image_name string, registry string>>>>"
RECORD = "biotoolsID string, function array<struct<operation array<struct<uri string, term string>>>>, _corrupt string"


def parse_containers(spark: SparkSession, path: str, *, ingested_at: str, source: str = "containers") -> tuple[DataFrame, DataFrame]:
    """(entity, rel): a package per record, a container per named image, FROM_PACKAGE between them."""
    raw = spark.read.schema(CONTAINER).option("multiLine", True).json(path).where("coalesce(name, '') <> ''")
    pkg = F.concat(F.lit("pkg:"), "name")
    tail = [F.lit(source).alias("source"), F.lit(path).alias("source_url"), F.lit(ingested_at).alias("ingested_at")]
    no = [F.lit("").alias("bioconda_pkg"), F.lit("").alias("biotools_id")]
    packages = raw.select(pkg.alias("id"), "name", F.lit("Package").alias("kind"), F.lit('{"channel": "bioconda"}').alias("properties"), *no, *tail)
    images = raw.select("name", F.explode("versions").alias("v")).select("name", F.col("v.meta_version").alias("version"), F.explode("v.images").alias("i")).where("coalesce(i.image_name, '') <> ''")
    image = F.col("i.image_name")
    props = F.format_string('{"image_name": "%s", "registry": "%s", "version": "%s"}', image, F.coalesce("i.registry", F.lit("")), F.coalesce("version", F.lit("")))
    containers = images.select(F.concat(F.lit("ctr:"), image).alias("id"), image.alias("name"), F.lit("Container").alias("kind"), props.alias("properties"), *no, *tail)
    rel = images.select(F.concat(F.lit("ctr:"), image).alias("from_id"), pkg.alias("to_id"), F.lit("FROM_PACKAGE").alias("kind"), F.lit("{}").alias("properties"), *tail).distinct()
    return packages.unionByName(containers).distinct(), rel


def parse_registry(spark: SparkSession, path: str) -> DataFrame:
    """(registry_id, operations), ids in lower case, operations sorted; a broken file is passed over and of two files with one
    id the later, by name, counts."""
    raw = spark.read.schema(RECORD).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.select(F.lower(F.trim("biotoolsID")).alias("registry_id"), "function", F.input_file_name().alias("file")).where("coalesce(registry_id, '') <> ''")
    uris = F.flatten(F.transform(F.coalesce("function", F.array().cast("array<struct<operation:array<struct<uri:string,term:string>>>>")), lambda f: F.transform(F.coalesce(f["operation"], F.array().cast("array<struct<uri:string,term:string>>")), lambda o: o["uri"])))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform(uris, uri_id), lambda x: x.startswith("op:"))))
    return raw.select("registry_id", ids.alias("operations"), "file").groupBy("registry_id").agg(F.max_by("operations", "file").alias("operations"))


def wanted_ids(tools: DataFrame) -> DataFrame:
    """(what, id): the distinct packages and registry ids of read manifests, for fetching."""
    return tools.select(F.lit("package").alias("what"), F.col("package").alias("id")).union(tools.select(F.lit("registry"), F.lower("registry"))).where("coalesce(id, '') <> ''").distinct().orderBy("what", "id")
