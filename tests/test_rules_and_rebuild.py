"""Portable rules against a built graph, and building, rebuilding and ingesting from a folder of snapshots."""

import json

import pytest

from lattix import cli, rules
from lattix.graph import PropertyGraph
from lattix.operators import runner
from lattix.plans import rebuild

LINKS = """
links:
  - {method: m:salt, statistical_method: stat:wald, label: Wald test, evidence: {doi: 10/1, pmid: "1"}}
  - {method: m:salt, statistical_method: stat:bh, evidence: {pmid: "2"}, confidence: low}
  - {method: m:pepper, statistical_method: stat:bh, evidence: {doi: 10/3}}
"""
ASSUMPTIONS = """
statistical_methods:
  - {id: stat:wald, name: Wald, reference: "doi:10/w"}
  - {id: stat:bh, name: Benjamini}
assumptions:
  - {id: assum:normal, name: Normality}
  - {id: assum:free, name: Independence}
requires:
  - {statistical_method: stat:wald, assumption: assum:normal, evidence: "url:http://x"}
  - {statistical_method: stat:bh, assumption: assum:free, evidence: "doi:10/f"}
"""
DIAGNOSTICS = """
diagnostics:
  size: {name: Size, checks: [normal, "assum:free"], applies_to_assumption: normal, checkable: pre_run, min_replicates_per_group: 3, ref: "doi:10/s"}
  plot: {name: Plot, checks: [free], checkable: post_run, ref: "url:http://p"}
"""
EMPTY = {"operation_amenable_statistics.yaml": "links: []", "assay_methods.yaml": "links: []", "modalities.yaml": "modalities: {k: {name: K}}\npipelines: {cook: [k]}"}
MORE = {"data_types.yaml": "data_types: {t: {edam: data_1}}\ntool_io: {salt: {produces: [t]}, pepper: {consumes: [t]}}", "method_operations.yaml": "methods: {salt: {add: [operation_2], remove: [operation_1]}}"}


@pytest.fixture
def snapshots(tmp_path):
    root = tmp_path / "snapshots"
    (root / "curated").mkdir(parents=True)
    files = {"method_statistical_methods.yaml": LINKS, "statistical_method_assumptions.yaml": ASSUMPTIONS, "assumption_diagnostics.yaml": DIAGNOSTICS, **EMPTY, **MORE}
    for name, content in files.items():
        (root / "curated" / name).write_text(content)
    head = "Class ID\tPreferred Label\tParents\tObsolete\n"
    (root / "EDAM.tsv").write_text(head + "".join(f"http://e/{c}\t{c}\t\tFALSE\n" for c in ("operation_1", "operation_2", "data_1")))
    for tool in ("salt", "pepper"):
        at = root / "modules" / "nf-core" / tool
        at.mkdir(parents=True)
        (at / "meta.yml").write_text(f"name: {tool}\ntools:\n  - {tool}: {{edam_operations: ['http://e/operation_1']}}\n")
    skill = root / "skills" / "bioclaw" / "s"
    skill.mkdir(parents=True)
    (skill / "SKILL.md").write_text("---\nname: seasoning\ntools: [salt]\n---\nUse salt and pepper.\n")
    return root


def statuses(verdicts):
    return {r["method_id"]: r["status"] for r in verdicts.collect()}


def test_rules_agree_with_a_graph(spark, snapshots, tmp_path):
    r = rules.load_rules(spark, str(snapshots / "curated"))
    assert r.method_ids() == ["m:pepper", "m:salt"]
    got = {x["assumption"]: x for x in r.method_preconditions("m:salt").collect()}
    assert got["Normality"]["min_replicates_per_group"] == 3 and got["Normality"]["evidence"] == "doi:10/s" and got["Normality"]["via"] == ["Wald test"]
    assert got["Independence"]["min_replicates_per_group"] is None and got["Independence"]["evidence"] == "doi:10/f" and got["Independence"]["checkable"] == "pre_run" and got["Independence"]["diagnostics"] == ["diag:plot", "diag:size"]
    with pytest.raises(KeyError):
        r.method_preconditions("m:gone")
    assert rebuild.rebuild(spark, str(snapshots), f"{tmp_path}/g", ingested_at="d") == 0
    graph = PropertyGraph.open(spark, f"{tmp_path}/g")
    for facts, want in (({}, "FACTS_REQUIRED"), ({"replicates_per_group": 2}, "BLOCKED"), ({"replicates_per_group": 3}, "EVALUABLE")):
        for m in ("m:salt", "m:pepper"):
            ours, built = r.evaluate(m, facts)[0].first()["status"], graph.evaluate(method=m, facts=facts)[0].first()["status"]
            assert ours == built == (want if m == "m:salt" else "EVALUABLE"), (m, facts)  # few replicates block the one method only


def test_rebuild(spark, snapshots, tmp_path, capsys):
    path, lock = f"{tmp_path}/g", tmp_path / "graph.lock.json"
    assert rebuild.rebuild(spark, str(snapshots), path, diff_only=True) == 1  # no lock yet
    assert rebuild.rebuild(spark, str(snapshots), path, ingested_at="d") == 0
    rel = {tuple(r) for r in PropertyGraph.open(spark, path).rel.select("from_id", "kind", "to_id").collect()}
    assert {("m:salt", "PERFORMS", "op:operation_2"), ("m:pepper", "PERFORMS", "op:operation_1"), ("m:salt", "OUTPUT", "data:data_1"), ("assum:normal", "CHECKED_BY", "diag:size"), ("skill:bioclaw/seasoning", "WRAPS", "m:salt"), ("stat:wald", "REQUIRES_ASSUMPTION", "assum:normal")} <= rel
    assert ("m:salt", "PERFORMS", "op:operation_1") not in rel
    before = lock.read_text()
    (snapshots / "curated" / "method_operations.yaml").write_text("methods: {salt: {remove: [operation_1]}}")
    assert rebuild.rebuild(spark, str(snapshots), path, ingested_at="d", check=True) == 1 and lock.read_text() == before
    lock.write_text(json.dumps({"graph_hash": PropertyGraph.open(spark, f"{path}.check").fingerprint(runs=True)}))
    assert rebuild.rebuild(spark, str(snapshots), path, ingested_at="later", check=True) == 0
    (snapshots / "snapshot.json").write_text(json.dumps({"sources": {"ontology": {"sha256": "0" * 64}}}))
    assert rebuild.rebuild(spark, str(snapshots), path) == 1 and "differs" in capsys.readouterr().out
    assert rebuild.changes({"counts": {"nodes": 1}, "graph_hash": "a"}, {"counts": {"nodes": 2}, "graph_hash": "b"}) == [("counts.nodes", 1, 2)]


def test_ingest(spark, snapshots, tmp_path):
    manifest = snapshots / "m.yaml"
    manifest.write_text("sources: {ontology: EDAM.tsv, curated: curated}\npipelines: [{name: cook, revision: '1'}, {name: gone, revision: '2'}]\n")
    with pytest.raises(RuntimeError, match="none of the pipelines"):
        rebuild.ingest(spark, str(manifest), f"{tmp_path}/d", f"{tmp_path}/g", ingested_at="d")
    cook = tmp_path / "d" / "pipelines" / "cook"
    for tool in ("salt", "pepper"):
        at = cook / "modules" / "nf-core" / tool
        at.mkdir(parents=True)
        (at / "meta.yml").write_text(f"name: {tool}\ntools:\n  - {tool}: {{edam_operations: ['http://e/operation_1']}}\n")
    (cook / "modules.json").write_text(json.dumps({"repos": {"r": {"modules": {"nf-core": {"salt": {}, "pepper": {}}}}}}))
    (cook / "main.nf").write_text("include { SALT } from '../modules/nf-core/salt/main'\ninclude { PEPPER } from '../modules/nf-core/pepper/main'\n")
    (cook / "dag.mmd").write_text(runner.chart_of([("SALT", "PEPPER")]))
    lock = rebuild.ingest(spark, str(manifest), f"{tmp_path}/d", f"{tmp_path}/g", ingested_at="d")
    assert lock["missing"] == ["gone@2"] and lock["pipeline_nodes"] == 1 and not lock["failures"]
    rel = PropertyGraph.open(spark, f"{tmp_path}/g").rel
    flow = rel.where("kind = 'DOWNSTREAM_OF'").first()
    assert (flow["from_id"], flow["to_id"]) == ("mod:salt", "mod:pepper") and json.loads(flow["properties"]) == {"attestations": 1, "confidence": 0.95, "derivation": "nextflow_dsl2", "pipelines": ["cook"]}
    assert rel.where("kind = 'HAS_MODALITY' and from_id = 'pipe:cook'").count() == 1
    manifest.write_text("sources: {ontology: none.tsv}\n")
    with pytest.raises(FileNotFoundError):
        rebuild.ingest(spark, str(manifest), f"{tmp_path}/d", f"{tmp_path}/h", ingested_at="d")


def test_command_line(spark, snapshots, tmp_path, capsys):
    run = lambda *a: (cli.main(["--graph", f"{tmp_path}/g", *a]), capsys.readouterr().out)
    assert run("rebuild", "--snapshots", str(snapshots))[0] == 0
    code, said = run("guardrail", "--method", "m:salt", "--fact", "replicates_per_group=2")
    assert code == 3 and "BLOCKED  (m:salt)" in said and "[FAIL] Normality: replicates_per_group supplied=2 >= 3?" in said
    code, said = run("guardrail-chain", "m:salt", "m:pepper", "--fact", "replicates_per_group=3")
    assert code == 0 and "CHAIN: EVALUABLE" in said and "[VALID] via data:data_1" in said
    code, said = run("audit")
    assert code == 0 and "ALL CHECKS PASSED" in said
    assert "Wald" in run("explain", "m:salt")[1] and run("explain", "m:none")[0] == 4
    assert json.loads(run("skills", "--coverage")[1]) == {"skill_id": "skill:bioclaw/seasoning", "n_wired": 1, "n_evaluable": 1, "gap": ""}
    assert run("hash")[1].startswith("sha256:") and run("hash", "--runs")[1].startswith("sha256-runs:")


def test_answers_as_lines_and_clones(spark, tmp_path):
    items = spark.createDataFrame([("a", "whole", "g", ["x"]), ("b", "next", "g", ["x"])], "id string, task string, goal string, given array<string>")
    out = f"{tmp_path}/r/answers.jsonl"
    assert runner.run_to_lines(items.where("id = 'a'"), runner.static({"a": "one"}), out) == 1
    assert runner.run_to_lines(items, runner.static({}), out) == 1  # what is there is not asked again
    assert [(r["id"], r["raw"], (r["error"] or "")[:8]) for r in runner.read_results(spark, out).orderBy("id").collect()] == [("a", "one", ""), ("b", None, "KeyError")]
    for name, chart in (("p", runner.chart_of([("A", "B")])), ("q", None)):
        at = tmp_path / "clones" / name
        at.mkdir(parents=True)
        (at / "modules.json").write_text(json.dumps({"repos": {"r": {"modules": {"o": {"a": {}}}}}}))
        if chart:
            (at / "dag.mmd").write_text(chart)
    modules = spark.createDataFrame([("A", "m:a"), ("B", "m:b")], "step string, method_id string")
    sequences, outcomes = runner.read_clones(spark, f"{tmp_path}/clones", modules)
    assert sequences.count() == 2 and {(r["item"], r["reason"]) for r in outcomes.collect()} == {("p", None), ("q", "no chart")}
