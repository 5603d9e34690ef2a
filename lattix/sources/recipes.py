"""Execution recipes: containers, commands and channels read from workflow process files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattix.functions.canon import canonical

_CONTAINER = re.compile(r"^\s*container\s+(.+?)(?=^\s*(?:input|output|when|script|conda|label|tag)\b|\Z)", re.S | re.M)
_QUOTED = re.compile(r"['\"]([^'\"]*[/:][^'\"]*)['\"]")
_SECTION = re.compile(r"^\s*(input|output|when|script|shell|stub|exec):\s*$", re.M)
_NAME = re.compile(r"\b(?:path|val|file|env)\s*\(?\s*['\"]?([\w*.${}-]+)|emit:\s*(\w+)")
_TEMPLATE = re.compile(r"^\s*template\s+['\"]([^'\"]+)['\"]", re.M)
_HEREDOC = re.compile(r"(\"\"\"|''')(.*?)\1", re.S)


def containers(text: str) -> tuple[str, str]:
    """(image, singularity image) of a process: an image that is a web address is for singularity."""
    m = _CONTAINER.search(text)
    images = [q for q in _QUOTED.findall(m[1])] if m else []
    web = [i for i in images if i.startswith(("http://", "https://"))]
    plain = [i for i in images if i not in web and "workflow." not in i]
    return (plain[0] if plain else "", web[0] if web else "")


def command(text: str) -> dict[str, str]:
    """What a process runs: a template's name, the first line of its script, or unknown."""
    if m := _TEMPLATE.search(text):
        return {"kind": "template", "ref": m[1]}
    script = text[m.end() :] if (m := re.search(r"^\s*script:\s*$", text, re.M)) else ""
    if m := _HEREDOC.search(script):
        lines = [x.strip() for x in m[2].splitlines() if x.strip()]
        return {"kind": "heredoc", "ref": lines[0] if lines else ""}
    return {"kind": "unknown", "ref": ""}


def channels(text: str, section: str) -> list[str]:
    """The names in the ``input`` or ``output`` section."""
    marks = list(_SECTION.finditer(text))
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        if m[1] == section:
            body = text[m.end() : after.start() if after else len(text)]
            return list(dict.fromkeys(a or b for a, b in _NAME.findall(body)))
    return []


def read_recipes(spark: SparkSession, root: str) -> DataFrame:
    """(path, image, singularity, command, inputs, outputs) of every ``main.nf`` below the folder."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path, c in zip(pdf["path"], pdf["content"], strict=True):
                text = c.decode("utf-8", "replace")
                rows.append((path, *containers(text), canonical(command(text)), channels(text, "input"), channels(text, "output")))
            yield pd.DataFrame(rows, columns=["path", "image", "singularity", "command", "inputs", "outputs"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "main.nf").load(root).select("path", "content")
    return files.mapInPandas(parse, "path string, image string, singularity string, command string, inputs array<string>, outputs array<string>")


def build_specs(recipes: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(specs, skipped) of recipes with a module_id: the first by path is a module's spec, all distinct images its variants;
    a recipe is skipped if its module isn't in the graph or none of its module's recipes has an image."""
    known = modules.select(F.col("id").alias("module_id")).distinct()
    lost = recipes.join(known, "module_id", "left_anti").select("module_id", F.lit("module missing").alias("reason")).distinct()
    r = recipes.join(known, "module_id", "left_semi").withColumn("any_image", F.coalesce(F.nullif("image", F.lit("")), F.col("singularity")))
    bare = r.groupBy("module_id").agg(F.max(F.col("any_image") != "").alias("has")).where("not has").select("module_id", F.lit("no image").alias("reason"))
    r = r.where("any_image <> ''")
    images = r.groupBy("module_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("path", "any_image"))), lambda x: x["any_image"])).alias("variants"))
    first = r.withColumn("n", F.row_number().over(Window.partitionBy("module_id").orderBy("path"))).where("n = 1").drop("n", "any_image")
    specs = first.join(images, "module_id").withColumn("spec_id", F.regexp_replace("module_id", "^mod:", "exec:"))
    return specs.withColumn("variants", F.when(F.size("variants") > 1, F.col("variants")).otherwise(F.array().cast("array<string>"))), lost.unionByName(bare)
