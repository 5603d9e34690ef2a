"""Manifests, snapshots, locks and evaluation items: small files that the driver reads."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Sources that a manifest may name.
SOURCES = ["ontology", "modules", "containers", "registry", "stato", "obi", "skills", "curated"]
ITEM = "id string, task string, goal string, given array<string>, gold struct<sequence: array<string>, edges: array<array<string>>, next: string, source: string, nxf_ver: string, dag_sha256: string, derivation: string>"


@dataclass
class Manifest:
    sources: dict[str, str] = field(default_factory=dict)
    pipelines: list[dict[str, str]] = field(default_factory=list)


def load_manifest(path: str) -> Manifest:
    """A YAML manifest; unknown sources and pipelines without a name or a revision are errors."""
    import yaml

    data = yaml.safe_load(Path(path).read_text()) or {}
    sources, pipelines = data.get("sources") or {}, data.get("pipelines") or []
    if unknown := sorted(set(sources) - set(SOURCES)):
        raise ValueError(f"unknown sources: {', '.join(unknown)}")
    for p in pipelines:
        if not p.get("name") or not p.get("revision"):
            raise ValueError(f"a pipeline needs a name and a revision: {p}")
    return Manifest({k: str(v) for k, v in sources.items()}, pipelines)


def resolve_sources(manifest: Manifest, root: str) -> dict[str, Path]:
    """The sources' paths; all that are missing are named in one error."""
    paths = {k: Path(root) / v for k, v in manifest.sources.items()}
    if missing := [str(p) for p in paths.values() if not p.exists()]:
        raise FileNotFoundError(", ".join(missing))
    return paths


def file_digest(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def verify_snapshots(root: str, pins: dict[str, str]) -> list[tuple[str, str, str]]:
    """(file, expected, actual) of pinned files that differ; a missing file is MISSING and unpinned ones are passed over."""
    out = []
    for name, want in sorted(pins.items()):
        p = Path(root) / name
        have = file_digest(p) if p.exists() else "MISSING"
        if want and have != want:
            out.append((name, want, have))
    return out


def write_lock(path: str, lock: dict) -> None:
    Path(path).write_text(json.dumps(lock, indent=2, sort_keys=True) + "\n")


def read_lock(path: str) -> dict | None:
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return None


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items by id; none at all is an error."""
    items = spark.read.schema(ITEM).option("multiLine", True).json(path)
    if items.isEmpty():
        raise ValueError(f"no items below {path}")
    return items.orderBy("id")
