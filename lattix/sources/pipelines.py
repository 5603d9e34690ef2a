"""Pipelines: membership lists, wiring from include statements and flow charts, or from what modules read and write."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions import kernels

_INCLUDE = re.compile(r"include\s*\{([^}]*)\}\s*from\s*['\"]([^'\"]+)['\"]")


def io_overlap(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(pipeline, a, b): modules of a pipeline of which one writes what another reads; both are (pipeline, module_id, data)."""
    a, b = outputs.select("pipeline", "data", F.col("module_id").alias("a")).distinct(), inputs.select("pipeline", "data", F.col("module_id").alias("b")).distinct()
    return a.join(b, ["pipeline", "data"]).where("a <> b").select("pipeline", "a", "b").distinct()


def module_paths(text: str) -> list[str]:
    """The module paths that a pipeline's membership list declares, sorted."""
    repos = json.loads(text).get("repos") or {}
    return sorted({path for r in repos.values() for group in (r.get("modules") or {}).values() for path in group})


def includes(text: str) -> dict[str, str]:
    """Process names to module paths, by the include statements of a workflow file."""
    out = {}
    for names, path in _INCLUDE.findall(text):
        for part in filter(None, (p.strip() for p in names.split(";"))):
            out[part.split(" as ")[-1].strip()] = path
    return out


def read_membership(spark: SparkSession, root: str) -> DataFrame:
    """(pipeline, path): the modules that each ``modules.json`` below the folder declares."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p.rstrip("/").split("/")[-2], m) for p, c in zip(pdf["path"], pdf["content"], strict=True) for m in module_paths(c.decode())]
            yield pd.DataFrame(rows, columns=["pipeline", "path"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "modules.json").load(root)
    return files.select("path", "content").mapInPandas(parse, "pipeline string, path string")


def _texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(pipeline, text) of the files of a name below a folder of pipelines; the folder next below it names the pipeline."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    below = F.substring_index("path", f"/{root.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return files.select(F.substring_index(below, "/", 1).alias("pipeline"), F.col("content").cast("string").alias("text"))


def read_charts(spark: SparkSession, root: str) -> DataFrame:
    """(pipeline, text) of every ``dag.mmd`` below the folder."""
    return _texts(spark, root, "dag.mmd")


def read_aliases(spark: SparkSession, root: str) -> DataFrame:
    """(pipeline, process, path): which module each process of a pipeline's workflow files runs; a name that different files
    give to different modules says nothing and is left out."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p, n, m[1]) for p, t in zip(pdf["pipeline"], pdf["text"], strict=True) for n, path in includes(t).items() if (m := re.search(r"nf-core/(.+?)(?:/main)?$", path))]
            yield pd.DataFrame(rows, columns=["pipeline", "process", "path"])

    found = _texts(spark, root, "*.nf").mapInPandas(parse, "pipeline string, process string, path string").distinct()
    return found.groupBy("pipeline", "process").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").drop("n")


def parse_pipelines(membership: DataFrame, metas: DataFrame, charts: DataFrame | None = None, aliases: DataFrame | None = None, *, module_io: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, wiring).  members: (pipeline, module_id) by joining declared paths to the modules' (path, module_id), unresolved
    ones dropped.  wiring: (pipeline, a, b, derivation, confidence), from the flow chart (pipeline, text) with (pipeline, process,
    module_id) aliases where a pipeline has one, else from overlapping data, if (outputs, inputs) of modules are given.  Pipelines are
    many and modules few, so what is known of modules is broadcast and no task gets a module's rows of all pipelines."""
    members = membership.join(F.broadcast(metas), "path").select("pipeline", "module_id").distinct()
    wiring = None
    if charts is not None and aliases is not None:

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                yield pd.DataFrame([(p, r, a, b) for p, t in zip(pdf["pipeline"], pdf["text"], strict=True) for r, a, b in kernels.process_edges(t)], columns=["pipeline", "rank", "pa", "pb"])

        edges = charts.select("pipeline", "text").mapInPandas(run, "pipeline string, rank int, pa string, pb string")
        to = lambda c, n: aliases.select("pipeline", F.col("process").alias(c), F.col("module_id").alias(n))
        edges = edges.join(to("pa", "a"), ["pipeline", "pa"]).join(to("pb", "b"), ["pipeline", "pb"]).where("a <> b")
        edges = edges.groupBy("pipeline", "a", "b").agg(F.min("rank").alias("rank"))
        from lattix.operators.evalkit import break_cycles

        wired = break_cycles(edges.select(F.col("pipeline").alias("grp"), "rank", "a", "b"))
        wiring = wired.select(F.col("grp").alias("pipeline"), "a", "b", F.lit("nextflow_dsl2").alias("derivation"), F.lit(0.95).alias("confidence"))
    if module_io is not None:
        o, i = (members.join(F.broadcast(df.select("module_id", "data")), "module_id") for df in module_io)
        inferred = io_overlap(o, i).select("pipeline", "a", "b", F.lit("io_inferred").alias("derivation"), F.lit(0.5).alias("confidence"))
        if wiring is not None:
            inferred = inferred.join(charts.select("pipeline").distinct(), "pipeline", "left_anti")
        wiring = inferred if wiring is None else wiring.unionByName(inferred)
    return members, wiring
