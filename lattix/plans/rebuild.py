"""From a folder of snapshots to an audited, locked graph: build, rebuild and ingest."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions.canon import properties
from lattix.graph import PropertyGraph
from lattix.plans.build import build
from lattix.plans.runtime import cut
from lattix.sources import manifest as M
from lattix.sources import modules, owl, pipelines, registry, tsv

# Where a folder of snapshots keeps each source.
LAYOUT = {"ontology": "EDAM.tsv", "modules": "modules", "containers": "biocontainers", "registry": "biotools", "stato": "stato.owl", "obi": "obi.owl", "skills": "skills/bioclaw", "curated": "curated"}


def pipeline_tables(spark: SparkSession, root: str, tools: DataFrame, *, wiring: bool = True, ingested_at: str) -> tuple[DataFrame, DataFrame]:
    """(entity, rel) of the pipelines below a folder: each with its modules, and the flow between these from its chart and its
    include statements where it has them, else from what modules read and write."""
    metas = tools.where("error is null").select(F.regexp_extract("path", r"nf-core/(.*)/[^/]*$", 1).alias("path"), F.concat(F.lit("mod:"), "module").alias("module_id"), "inputs", "outputs").where("path <> ''")
    io = [metas.select("module_id", F.explode(c).alias("data")).distinct() for c in ("outputs", "inputs")]
    charts = pipelines.read_charts(spark, root) if wiring else None
    aliases = pipelines.read_aliases(spark, root).join(metas.select("path", "module_id").distinct(), "path").select("pipeline", "process", "module_id") if wiring else None
    members, flow = pipelines.parse_pipelines(pipelines.read_membership(spark, root), metas.select("path", "module_id").distinct(), charts, aliases, module_io=tuple(io))
    tail = [F.lit("pipelines").alias("source"), F.lit(root).alias("source_url"), F.lit(ingested_at).alias("ingested_at")]
    pipe = F.concat(F.lit("pipe:"), "pipeline")
    blank = F.lit("")
    entity = members.select("pipeline").distinct().select(pipe.alias("id"), F.col("pipeline").alias("name"), F.lit("Pipeline").alias("kind"), F.lit("{}").alias("properties"), blank.alias("bioconda_pkg"), blank.alias("biotools_id"), *tail)
    rel = members.select(pipe.alias("from_id"), F.col("module_id").alias("to_id"), F.lit("HAS_MODULE").alias("kind"), F.lit("{}").alias("properties"), *tail)
    props = properties(attestations=F.lit(1), confidence=F.col("confidence"), derivation=F.col("derivation"), pipelines=F.array("pipeline"))
    return entity, rel.unionByName(flow.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("DOWNSTREAM_OF").alias("kind"), props.alias("properties"), *tail))


def build_from(spark: SparkSession, sources: dict[str, str], path: str, *, ingested_at: str, pipelines_root: str | None = None, wiring: bool = True, lock: str | None = None) -> dict:
    """Build the graph of the sources that are given, by their names in ``LAYOUT``; the report is that of ``build``."""
    parts: list[tuple[DataFrame, DataFrame]] = []
    if "ontology" in sources:
        parts.append(tsv.parse_ontology_table(spark, sources["ontology"], ingested_at=ingested_at))
    tools = None
    if root := (pipelines_root or sources.get("modules")):
        tools = cut(modules.read_modules(spark, root))  # parsed once
        parts.append(modules.build_modules(tools, ingested_at=ingested_at)[:2])
    if pipelines_root:
        parts.append(pipeline_tables(spark, pipelines_root, tools, wiring=wiring, ingested_at=ingested_at))
    if "containers" in sources:
        parts.append(registry.parse_containers(spark, sources["containers"], ingested_at=ingested_at))
    for name, parse in (("stato", owl.parse_stato), ("obi", owl.parse_obi)):
        if name in sources:
            parts.append(parse(spark, sources[name], ingested_at=ingested_at))
    records = registry.parse_registry(spark, sources["registry"]) if "registry" in sources else None
    return build(spark, parts, path, ingested_at=ingested_at, lock=lock, registry=records, curated=sources.get("curated"), skills=sources.get("skills"))


def lock_of(spark: SparkSession, path: str, report: dict, **more) -> dict:
    """What a build made: its fingerprint, counts and coverage."""
    coverage = {r["metric"]: {"n": r["n"], "percent": r["percent"]} for r in PropertyGraph.open(spark, path).coverage().collect()}
    return {"graph_hash": report["fingerprint"], "ingested_at": report["ingested_at"], "counts": {k: report[k] for k in ("nodes", "edges_loaded", "edges_dropped")}, "coverage": coverage} | more


def changes(before: dict, after: dict, at: str = "") -> list[tuple[str, object, object]]:
    """(metric, before, after) of the counts and coverage of two locks that differ."""
    out = []
    for k in sorted(set(before) | set(after)):
        a, b, name = before.get(k), after.get(k), f"{at}{k}"
        if isinstance(a, dict) and isinstance(b, dict):
            out += changes(a, b, f"{name}.")
        elif a != b and name not in ("ingested_at", "graph_hash"):
            out.append((name, a, b))
    return out


def committed(lock: Path) -> dict | None:
    """The lock as the last commit has it; None without one."""
    try:
        said = subprocess.run(["git", "show", f"HEAD:./{lock.name}"], cwd=lock.parent, capture_output=True, text=True, check=True)
        return json.loads(said.stdout)
    except (OSError, ValueError, subprocess.CalledProcessError):
        return None


def _say_changes(lock: Path, new: dict) -> None:
    old = committed(lock)
    if old is None:
        print("coverage: no committed lock to compare with")
        return
    found = changes(old, new)
    print("coverage: changes against the committed lock" if found else "coverage: as in the committed lock")
    for name, a, b in found:
        print(f"  {name}: {a} -> {b}")


def rebuild(spark: SparkSession, snapshots: str, path: str, *, ingested_at: str | None = None, verify: bool = True, check: bool = False, diff_only: bool = False) -> int:
    """Verify the snapshots, build, audit, and write the lock beside the graph.  ``check`` compares the fingerprint with that of
    the lock and writes no lock; ``diff_only`` compares the lock with the committed one and builds nothing.  1 where
    snapshots differ from their digests, the audit fails or fingerprints differ."""
    lock = Path(path).parent / "graph.lock.json"
    if diff_only:
        have = M.read_lock(str(lock))
        if have is None:
            print(f"no lock at {lock}")
            return 1
        _say_changes(lock, have)
        return 0
    pinned = M.read_lock(f"{snapshots}/snapshot.json") or {}
    about = pinned.get("sources") or {}
    if verify:
        pins = {str(v.get("path") or LAYOUT.get(k, k)): v["sha256"] for k, v in about.items() if isinstance(v, dict) and v.get("sha256")}
        if bad := M.verify_snapshots(snapshots, pins):
            for name, want, have in bad:
                print(f"snapshot differs: {name}: expected {want[:16]}, is {have[:16]}")
            return 1
        print(f"verified {len(pins)} of {len(about)} sources; the others have no digest")
    sources = {k: f"{snapshots}/{v}" for k, v in LAYOUT.items() if (Path(snapshots) / v).exists()}
    report = build_from(spark, sources, path if not check else f"{path}.check", ingested_at=ingested_at or str(pinned.get("created_at", ""))[:10] or "unknown")
    if report["failures"]:
        print(f"the audit failed, no lock is written: {report['failures']}")
        return 1
    if check:
        have = (M.read_lock(str(lock)) or {}).get("graph_hash")
        print(f"lock {have}\nbuilt {report['fingerprint']}")
        return int(have != report["fingerprint"])
    new = lock_of(spark, path, report, sources=about)
    M.write_lock(str(lock), new)
    _say_changes(lock, new)
    return 0


def ingest(spark: SparkSession, manifest: str, dest: str, path: str, *, ingested_at: str) -> dict:
    """Build what a manifest names, from local copies: sources beside the manifest, pipelines below ``dest``/pipelines.  A missing
    source is an error before anything is built; a missing pipeline is recorded, unless all are missing.  The lock is
    written before a failed audit, or a graph without pipelines, raises."""
    spec = M.load_manifest(manifest)
    sources = {k: str(v) for k, v in M.resolve_sources(spec, str(Path(manifest).parent)).items()}
    root = Path(dest) / "pipelines"
    lost = [f"{p['name']}@{p['revision']}" for p in spec.pipelines if not (root / p["name"]).is_dir()]
    if spec.pipelines and len(lost) == len(spec.pipelines):
        raise RuntimeError(f"none of the pipelines is there: {', '.join(lost)}")
    report = build_from(spark, sources, path, ingested_at=ingested_at, pipelines_root=str(root) if spec.pipelines else None)
    n = PropertyGraph.open(spark, path).entity.where("kind = 'Pipeline'").count()
    digests = {k: M.file_digest(Path(v)) if Path(v).is_file() else "folder" for k, v in sources.items()}
    lock = lock_of(spark, path, report, manifest=manifest, pipelines=[p for p in spec.pipelines if f"{p['name']}@{p['revision']}" not in lost], missing=lost, sources=digests, failures=report["failures"], pipeline_nodes=n)
    M.write_lock(f"{dest}/ingest.lock.json", lock)
    if report["failures"]:
        raise RuntimeError(f"the audit failed: {report['failures']}")
    if spec.pipelines and not n:
        raise RuntimeError("pipelines are there, but the graph has none")
    return lock
