"""Module manifests: YAML files below a folder, each with tools, their ontology terms and what the module reads and writes.

Files are read by Spark and parsed where they are; a file that isn't a manifest is reported, not fatal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattix.functions.canon import properties
from lattix.functions.globs import format_ids
from lattix.functions.text import uri_id

_DEPENDENCY = re.compile(r"(?:([\w-]+)::)?([\w.-]+)=([\w.+-]+)")
#: The folder below which a path gives a tool's name.
MARKER = "nf-core"
TOOL = "path string, module string, description string, tool string, tool_description string, homepage string, registry string, operations array<string>, inputs array<string>, outputs array<string>, package string, version string, error string, pos int"


def walk(section: Any) -> Iterator[dict]:
    """All mappings inside an irregular nesting of lists and mappings, but for what ontology entries hold."""
    todo = [section]
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            yield x
            todo = [v for k, v in x.items() if k != "ontologies"] + todo
        elif isinstance(x, list):
            todo = x + todo


def section_types(section: Any) -> list[str]:
    """Ontology uris (of the one key that names the ontology in use), else formats of file patterns, of an input or output section."""
    found = list(walk(section))
    uris = [t["edam"] for d in found if isinstance(d.get("ontologies"), list) for t in d["ontologies"] if isinstance(t, dict) and isinstance(t.get("edam"), str) and t["edam"]]
    formats = [f for d in found if isinstance(p := d.get("pattern"), str) and p for f in format_ids(p)]
    return list(dict.fromkeys(uris + formats))


def package_of(dependencies: list, tool: str, alone: bool) -> tuple[str, str] | None:
    """(name, version) of the dependency named like the tool, else of the only one if the tool is the only one too."""
    found = [(m[2], m[3]) for d in dependencies if isinstance(d, str) and (m := _DEPENDENCY.search(d)) and m[1] in (None, "bioconda")]
    return next((f for f in found if f[0].lower() == tool.lower()), found[0] if alone and len(found) == 1 else None)


def tool_from_path(path: str) -> str:
    """The tool that a manifest's folder names, where folders are tool/subcommand below the marker."""
    parts = path.split("/")[:-1]
    if MARKER in parts:
        rest = parts[len(parts) - parts[::-1].index(MARKER) :]
        if len(rest) >= 2:
            return rest[0]
    return ""


def _rows(path: str, manifest: bytes, environment: bytes | None) -> list[tuple]:
    import yaml

    empty = (None,) * 11
    try:
        meta = yaml.safe_load(manifest)
        deps = ((yaml.safe_load(environment) or {}).get("dependencies") or []) if environment else []
        if not isinstance(meta, dict) or not meta.get("name"):
            return [(path, *empty, "no name", 0)]
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        return [(path, *empty, str(e)[:200], 0)]
    entries = meta.get("tools") if isinstance(meta.get("tools"), list) else []
    tools = [(str(n), d if isinstance(d, dict) else {}) for t in entries if isinstance(t, dict) for n, d in t.items() if n]
    io = section_types(meta.get("input")), section_types(meta.get("output"))
    given = tool_from_path(path)
    out, seen = [], set()
    for name, d in tools or [("", {})]:
        shown = given if given and len(tools) == 1 else name
        if shown.lower() in seen:
            continue
        seen.add(shown.lower())
        terms = [x for x in d.get("edam_operations") or [] if isinstance(x, str)]
        pkg = package_of(deps, shown, len(tools) == 1) or ("", "")
        ident = str(d.get("identifier") or "").removeprefix("biotools:").strip()
        out.append((path, str(meta["name"]), str(meta.get("description") or "").strip(), shown, str(d.get("description") or ""), str(d.get("homepage") or ""), ident, terms, *io, *pkg, None, len(out)))
    return out


def read_modules(spark: SparkSession, root: str) -> DataFrame:
    """One row per tool of every manifest below the folder, or one with the error."""
    load = lambda n: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", n).load(root)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    metas = load("meta.yml").select("path", folder.alias("dir"), F.col("content").alias("meta"))
    env = load("environment.yml").select(folder.alias("dir"), F.col("content").alias("env"))

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for p, m, e in zip(pdf["path"], pdf["meta"], pdf["env"], strict=True) for r in _rows(p, m, e if isinstance(e, (bytes, bytearray)) else None)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOOL.split(", ")])

    return metas.join(env, "dir", "left").select("path", "meta", "env").mapInPandas(parse, TOOL)


def build_modules(tools: DataFrame, *, ingested_at: str, source: str = "modules") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity, rel, skipped) of read manifests: modules, methods, synthetic formats and their edges.  A registry id that
    one module gives to several tools stays only with the one of that name."""
    skipped = tools.where("error is not null").select("path", "error")
    t = tools.where("error is null").withColumn("method_id", F.when(F.col("tool") != "", F.concat(F.lit("m:"), F.lower("tool"))))
    shared = F.size(F.collect_set(F.when(F.col("registry") != "", F.lower("tool"))).over(Window.partitionBy("path", F.lower("registry")))) > 1
    t = t.withColumn("shared", shared)
    t = t.withColumn("registry", F.when(F.col("shared") & (F.lower("registry") != F.lower("tool")), "").otherwise(F.col("registry"))).drop("shared")
    t = t.withColumn("module_id", F.concat(F.lit("mod:"), "module"))
    tail = [F.lit(source).alias("source"), F.col("path").alias("source_url"), F.lit(ingested_at).alias("ingested_at"), F.struct("path", "pos").alias("src_pos")]
    blank = F.lit("")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    described = properties(description=F.col("description"))
    about = properties(description=some("tool_description"), homepage=some("homepage"), version=some("version"), tool_label=some("tool"))
    node = lambda df, i, n, k, p, pkg=blank, reg=blank: df.select(i.alias("id"), n.alias("name"), F.lit(k).alias("kind"), p.alias("properties"), pkg.alias("bioconda_pkg"), reg.alias("biotools_id"), *tail)
    m = t.where("method_id is not null")
    entity = node(t.where("pos = 0"), F.col("module_id"), F.col("module"), "Module", described)
    entity = entity.unionByName(node(m, F.col("method_id"), F.col("tool"), "Method", about, F.col("package"), F.col("registry")))
    edge = lambda df, a, b, k: df.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(k).alias("kind"), F.lit("{}").alias("properties"), *tail).distinct()
    rel = edge(m, "module_id", "method_id", "WRAPS")
    ops = m.select("*", F.explode("operations").alias("uri")).withColumn("to_id", uri_id(F.col("uri"))).where("to_id like 'op:%'")
    rel = rel.unionByName(edge(ops, "method_id", "to_id", "PERFORMS"))
    for kind, column in (("INPUT", "inputs"), ("OUTPUT", "outputs")):
        x = m.select("*", F.explode(column).alias("type"))
        x = x.withColumn("to_id", F.when(F.col("type").startswith("fmt:"), F.col("type")).otherwise(uri_id(F.col("type")))).where("to_id like 'fmt:%' or to_id like 'data:%'")
        rel = rel.unionByName(edge(x, "method_id", "to_id", kind))
    made = rel.where("to_id like 'fmt:pat:%'").select("to_id").distinct()
    ending = F.substring("to_id", len("fmt:pat:") + 1, 1 << 20)
    pattern = properties(pattern=ending)
    formats = made.select(F.col("to_id").alias("id"), ending.alias("name"), F.lit("Format").alias("kind"), pattern.alias("properties"), blank.alias("bioconda_pkg"), blank.alias("biotools_id"), F.lit(source).alias("source"), F.lit("file patterns").alias("source_url"), F.lit(ingested_at).alias("ingested_at"), F.struct(F.lit("").alias("path"), F.lit(0).alias("pos")).alias("src_pos"))
    return entity.unionByName(formats), rel, skipped
