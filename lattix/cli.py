"""Command line: ``python -m lattix.cli --graph PATH COMMAND ...``.

Exit codes: guardrail and guardrail-chain 0 EVALUABLE, 3 BLOCKED, 4 NOT_EVALUABLE, 5 FACTS_REQUIRED; audit and rebuild 0 or 1;
explain 4 for an unknown method.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix import reports
from lattix.graph import PropertyGraph
from lattix.operators.contract import DIMENSIONS
from lattix.plans.rebuild import LAYOUT, build_from, ingest, rebuild
from lattix.sources.pipelines import read_charts

CODES = {"EVALUABLE": 0, "BLOCKED": 3, "NOT_EVALUABLE": 4, "FACTS_REQUIRED": 5}


def facts(pairs: list[str]) -> dict[str, int]:
    out = {}
    for p in pairs:
        key, _, value = p.partition("=")
        if not key or not value.isdigit() or int(value) <= 0:
            raise SystemExit(f"a fact is key=positive number, not {p}")
        out[key] = int(value)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattix")
    p.add_argument("--graph", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("keywords", nargs="*")
    q.add_argument("--k-hops", type=int, default=1)
    sub.add_parser("methods").add_argument("keywords", nargs="*")
    s = sub.add_parser("suggest")
    s.add_argument("frontier", nargs="+")
    s.add_argument("--limit", type=int, default=10)
    g = sub.add_parser("guardrail")
    g.add_argument("--method")
    g.add_argument("--skill")
    g.add_argument("--analysis", nargs="*")
    g.add_argument("--fact", action="append", default=[])
    g.add_argument("--json", action="store_true")
    g = sub.add_parser("guardrail-chain")
    g.add_argument("methods", nargs="+")
    g.add_argument("--fact", action="append", default=[])
    sub.add_parser("explain").add_argument("method")
    sub.add_parser("audit").add_argument("--json", action="store_true")
    sub.add_parser("hash").add_argument("--runs", action="store_true")
    sub.add_parser("skills").add_argument("--coverage", action="store_true")
    sub.add_parser("export-kgx").add_argument("out")
    b = sub.add_parser("build")
    for name in LAYOUT:
        b.add_argument(f"--{name}")
    b.add_argument("--pipelines")
    b.add_argument("--no-wiring", action="store_true")
    b.add_argument("--ingested-at", default="unknown")
    r = sub.add_parser("rebuild")
    r.add_argument("--snapshots", required=True)
    r.add_argument("--ingested-at")
    for flag in ("no-verify", "check", "diff-only"):
        r.add_argument(f"--{flag}", action="store_true")
    i = sub.add_parser("ingest")
    i.add_argument("--manifest", required=True)
    i.add_argument("--dest", required=True)
    i.add_argument("--ingested-at", default="unknown")
    e = sub.add_parser("bench").add_subparsers(dest="bench", required=True)
    e.add_parser("build").add_argument("pipelines")
    e.add_parser("coverage").add_argument("pipelines")
    t = e.add_parser("run")
    t.add_argument("items")
    t.add_argument("--answers", required=True, help="a JSON object of answers by item, to be replayed")
    t.add_argument("--task")
    t.add_argument("--limit", type=int)
    t.add_argument("--out", required=True)
    t = e.add_parser("score")
    t.add_argument("items")
    t.add_argument("results")
    return p


def show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(json.dumps(r.asDict(recursive=True)))


def bench(spark: SparkSession, graph: PropertyGraph, a: argparse.Namespace) -> int:
    from lattix.operators import evalkit, runner
    from lattix.sources.manifest import load_items

    oracle = evalkit.oracle(graph.entity, graph.rel)
    if a.bench in ("build", "coverage"):
        modules = oracle["modules"].select(F.regexp_replace("step", "^mod:", "").alias("step"), "method_id")
        upper = modules.select(F.upper("step").alias("step"), "method_id")
        sequences, outcomes = runner.read_clones(spark, a.pipelines, modules.unionByName(upper).distinct())
        if a.bench == "build":
            show(sequences.orderBy("item", "pos"))
            show(runner.build_manifest(outcomes))
        else:
            steps = evalkit.gold_orders(read_charts(spark, a.pipelines).select(F.col("pipeline").alias("item"), "text")).select(F.concat(F.lit("mod:"), F.lower("step")).alias("step"))
            show(evalkit.oracle_coverage(oracle, steps))
            show(evalkit.class_sizes(evalkit.equivalence_classes(oracle["operations"], oracle["inputs"])).orderBy("op", "data"))
        return 0
    items = load_items(spark, a.items)
    if a.bench == "run":
        items = items.where(F.col("task") == a.task) if a.task else items
        items = items if a.limit is None else items.orderBy("id").limit(a.limit)
        print(runner.run_to_lines(items, runner.static(json.loads(Path(a.answers).read_text())), a.out))
        return 0
    scored = runner.rescore(runner.read_results(spark, a.results), items, graph.entity.where("kind = 'Method'"))
    show(scored.orderBy("id"))
    show(evalkit.run_summary(scored.withColumn("score", F.coalesce("f1", F.col("top1").cast("double")))))
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "build":
        sources = {k: v for k in LAYOUT if (v := getattr(a, k))}
        report = build_from(spark, sources, a.graph, ingested_at=a.ingested_at, pipelines_root=a.pipelines, wiring=not a.no_wiring)
        print(json.dumps(report))
        return int(bool(report["failures"]))
    if a.command == "rebuild":
        return rebuild(spark, a.snapshots, a.graph, ingested_at=a.ingested_at, verify=not a.no_verify, check=a.check, diff_only=a.diff_only)
    if a.command == "ingest":
        print(json.dumps(ingest(spark, a.manifest, a.dest, a.graph, ingested_at=a.ingested_at)))
        return 0
    graph = PropertyGraph.open(spark, a.graph)
    if a.command == "bench":
        return bench(spark, graph, a)
    if a.command == "query":
        for line in graph.context_lines(graph.resolve_method_ids(a.keywords), a.k_hops):
            print(line)
    elif a.command == "methods":
        show(graph.resolve_method_ids(a.keywords).orderBy("ord") if a.keywords else graph.catalogue().orderBy("method_id"))
    elif a.command == "suggest":
        show(graph.suggest(a.frontier, limit=a.limit).orderBy("ord"))
    elif a.command == "guardrail":
        verdict, gates = graph.evaluate(method=a.method, skill=a.skill, analysis=a.analysis, facts=facts(a.fact))
        row = verdict.first()
        if a.json:
            print(json.dumps(row.asDict()))
            show(gates)
        else:
            print(reports.verdict_text(row[0], row, gates.collect()))
        return CODES[row["status"]]
    elif a.command == "guardrail-chain":
        chain, steps, handoffs = graph.evaluate_chain(a.methods, facts(a.fact))
        row = chain.first()
        print(reports.chain_text(row, steps.collect(), handoffs.collect()))
        return CODES[row["status"]]
    elif a.command == "explain":
        try:
            print(reports.traces_text(a.method, graph.method_preconditions(a.method).collect(), DIMENSIONS))
        except KeyError:
            return 4
    elif a.command == "audit":
        if a.json:
            show(graph.audit().orderBy("name"))
        else:
            print(graph.audit_report())
        return int(not graph.audit().where("not ok").isEmpty())
    elif a.command == "hash":
        print(graph.fingerprint(runs=a.runs))
    elif a.command == "skills":
        show((graph.skill_coverage() if a.coverage else graph.entity.where("kind = 'Skill'").select(F.col("id").alias("skill_id"), "name")).orderBy("skill_id"))
    else:
        print(json.dumps(graph.export_kgx(a.out)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
