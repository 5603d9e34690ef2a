"""Skill libraries: Markdown files with a YAML head, wired to the methods that they declare."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions.canon import canonical

_HEAD = re.compile(r"\A---\s*\n(.*?)\n---\s*(?:\n|\Z)", re.S)


def parse_skill(text: str, vocabulary: set[str]) -> dict | None:
    """The head of a skill file, its declared tools, and the tools that its prose mentions besides; None without a name."""
    import yaml

    m = _HEAD.match(text)
    try:
        head = yaml.safe_load(m[1]) if m else None
    except yaml.YAMLError:
        return None
    if not isinstance(head, dict) or not head.get("name"):
        return None
    declared = head.get("tools") or ([head["primary_tool"]] if head.get("primary_tool") else [])
    declared = [str(t).strip() for t in ([declared] if isinstance(declared, str) else declared) if str(t).strip()]
    words = re.findall(r"[a-z0-9][a-z0-9_.+-]*", text[m.end() :].lower())
    said = {x for w in words for x in (w, w.rstrip(".-"))} & vocabulary
    return {
        "name": str(head["name"]), "description": str(head.get("description") or ""), "domain": str(head.get("domain") or ""),
        "primary_tool": declared[0] if declared else "", "tools": declared, "context_tools": sorted(said - {t.lower() for t in declared}),
    }


def read_skills(spark: SparkSession, root: str, vocabulary: set[str], *, library: str) -> DataFrame:
    """(skill_id, name, properties, tools) of every ``SKILL.md`` below the folder."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            found = [s for c in pdf["content"] if (s := parse_skill(c.decode("utf-8", "replace"), vocabulary))]
            rows = [(f"skill:{library}/{s['name']}", s["name"], canonical({"source": library} | {k: v for k, v in s.items() if k not in ("name", "tools") and v}), s["tools"]) for s in found]
            yield pd.DataFrame(rows, columns=["skill_id", "name", "properties", "tools"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "SKILL.md").load(root).select("content")
    return files.mapInPandas(parse, "skill_id string, name string, properties string, tools array<string>")


def wire_skills(skills: DataFrame, methods: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(wraps, unwired): (skill_id, method_id, tool, via) for declared tools that are methods, by alias (tool, method_id) or by
    name, and the (skill_id, tool) that are none."""
    t = skills.select("skill_id", F.explode("tools").alias("tool")).withColumn("key", F.lower("tool")).distinct()
    if aliases is not None:
        t = t.join(aliases.select(F.lower("tool").alias("key"), F.col("method_id").alias("alias")), "key", "left")
    else:
        t = t.withColumn("alias", F.lit(None).cast("string"))
    t = t.withColumn("method_id", F.coalesce("alias", F.concat(F.lit("m:"), "key"))).withColumn("via", F.when(F.col("alias").isNull(), "name").otherwise("alias"))
    known = methods.select(F.col("id").alias("method_id")).distinct()
    wraps = t.join(known, "method_id", "left_semi").groupBy("skill_id", "method_id").agg(F.min("tool").alias("tool"), F.min("via").alias("via"))
    return wraps, t.join(known, "method_id", "left_anti").select("skill_id", "tool").distinct()
