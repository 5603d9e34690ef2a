"""Ontologies in RDF/XML: named classes, their labels, synonyms and parents, classified under given roots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions.canon import properties
from lattix.plans.runtime import cut

# Names in the files, and the roots of the two ontologies with the kinds below them.
RDF, RDFS, OWL = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/2000/01/rdf-schema#}", "{http://www.w3.org/2002/07/owl#}"
SYNONYMS = ["hasExactSynonym", "hasRelatedSynonym", "hasBroadSynonym", "hasNarrowSynonym", "IAO_0000118"]
STATO_ROOTS = {"OBI_0200000": "StatisticalMethod", "STATO_0000142": "StatisticalMethod"}
OBI_ROOTS = {"OBI_0000070": "Assay", "OBI_0000272": "Protocol", "OBI_0500000": "StudyDesign", "OBI_0000968": "Instrument", "OBI_0100051": "Material"}


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """(uri, label, deprecated, synonyms, parents) of the named classes of the files; parents without a name are left out."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        for pdf in it:
            rows = []
            for content in pdf["content"]:
                for c in ElementTree.fromstring(content).iter(f"{OWL}Class"):
                    if uri := c.get(f"{RDF}about"):
                        label = next((x.text or "" for x in c.findall(f"{RDFS}label")), "").strip()
                        gone = any((x.text or "").strip().lower() == "true" for x in c.findall(f"{OWL}deprecated"))
                        syn = sorted({(x.text or "").strip() for x in c if x.tag.rsplit("}", 1)[-1] in SYNONYMS} - {""})
                        up = [p for x in c.findall(f"{RDFS}subClassOf") if (p := x.get(f"{RDF}resource"))]
                        rows.append((uri, label, gone, syn, up))
            yield pd.DataFrame(rows, columns=["uri", "label", "deprecated", "synonyms", "parents"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, "uri string, label string, deprecated boolean, synonyms array<string>, parents array<string>")


def classify(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) of everything below the roots in (child, parent) edges, roots included; of several, the least root.
    A round goes one level down and takes on only what is new or has found a lesser root."""
    found = cut(roots.select("id", F.col("id").alias("root")))
    front = found
    while not front.isEmpty():
        down = edges.join(front, edges["parent"] == front["id"]).groupBy(F.col("child").alias("id")).agg(F.min("root").alias("root"))
        old = found.select("id", F.col("root").alias("had"))
        front = cut(down.join(old, "id", "left").where("had is null or root < had").select("id", "root"))
        found = cut(found.unionByName(front).groupBy("id").agg(F.min("root").alias("root")))
    return found


def parse_ontology(spark: SparkSession, path: str, roots: dict[str, str], *, ingested_at: str, source: str, source_url: str) -> tuple[DataFrame, DataFrame]:
    """(entity, rel) of the classes below the roots.  A deprecated or unlabelled class is no node, but what is below it
    still counts as below the root; IS_A joins kept classes only."""
    classes = cut(read_classes(spark, path))
    local = lambda c: F.element_at(F.split(c, "[/#]"), -1)
    edges = classes.select(F.col("uri").alias("child"), F.explode("parents").alias("parent"))
    tops = spark.createDataFrame(list(roots.items()), "local string, kind string")
    named = classes.select("uri", local(F.col("uri")).alias("local")).unionByName(edges.select(F.col("parent").alias("uri"), local(F.col("parent")).alias("local"))).distinct()
    starts = named.join(tops, "local").select(F.col("uri").alias("id"))
    placed = classify(edges, starts).join(named.withColumnRenamed("uri", "root").join(tops, "local").select("root", "kind"), "root")
    kept = classes.where("not deprecated and label <> ''").join(placed.select(F.col("id").alias("uri"), "kind"), "uri")
    kept = kept.withColumn("id", F.concat(F.lit("obo:"), local(F.col("uri"))))
    props = properties(uri=F.col("uri"), ontology=F.lit(source), synonyms=F.when(F.size("synonyms") > 0, F.col("synonyms")))
    tail = [F.lit(source).alias("source"), F.lit(source_url).alias("source_url"), F.lit(ingested_at).alias("ingested_at")]
    entity = kept.select("id", F.col("label").alias("name"), "kind", props.alias("properties"), F.lit("").alias("bioconda_pkg"), F.lit("").alias("biotools_id"), *tail)
    up = kept.select(F.col("id").alias("from_id"), F.explode("parents").alias("parent")).join(kept.select(F.col("uri").alias("parent"), F.col("id").alias("to_id")), "parent")
    rel = up.select("from_id", "to_id", F.lit("IS_A").alias("kind"), F.lit("{}").alias("properties"), *tail).distinct()
    return entity.orderBy("id"), rel.orderBy("from_id", "to_id")


def parse_stato(spark: SparkSession, path: str, *, ingested_at: str) -> tuple[DataFrame, DataFrame]:
    """The statistical methods of a STATO file."""
    return parse_ontology(spark, path, STATO_ROOTS, ingested_at=ingested_at, source="STATO", source_url=path)


def parse_obi(spark: SparkSession, path: str, *, ingested_at: str) -> tuple[DataFrame, DataFrame]:
    """The assays, protocols, study designs, instruments and materials of an OBI file."""
    return parse_ontology(spark, path, OBI_ROOTS, ingested_at=ingested_at, source="OBI", source_url=path)
