"""A gate before commands: which method a command runs, what the workspace's sample sheet says, and the decision."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import SparkSession

from lattix.functions.facts import condition_column, smallest_arm
from lattix.graph import PropertyGraph

# How verdicts become decisions.
DECISIONS = {"BLOCKED": "deny", "FACTS_REQUIRED": "ask"}


def detect(command: str, patterns: dict[str, str]) -> str | None:
    """The first method whose pattern is in the command."""
    return next((m for m, p in patterns.items() if re.search(p, command, re.I)), None)


def workspace_facts(spark: SparkSession, workspace: str) -> dict[str, int]:
    """The smallest arm of the first sample sheet, by name, that has a condition column."""
    for path in sorted(Path(workspace).glob("*.csv")):
        samples = spark.read.option("header", True).csv(str(path))
        if column := condition_column(samples):
            n = smallest_arm(samples.where(f"coalesce(`{column}`, '') <> ''"), column).first()["smallest_arm"]
            if n:
                return {"replicates_per_group": n}
    return {}


def decide(graph: PropertyGraph, command: str, workspace: str, patterns: dict[str, str]) -> dict | None:
    """{decision, method_id, status, facts}, or None where there is nothing to say."""
    method = detect(command, patterns)
    if method is None:
        return None
    facts = workspace_facts(graph.spark, workspace)
    status = graph.evaluate(method=method, facts=facts)[0].first()["status"]
    return {"decision": DECISIONS[status], "method_id": method, "status": status, "facts": facts} if status in DECISIONS else None
