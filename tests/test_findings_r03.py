"""Findings of round 3: what a query asks for is built and no more, wide products are spread, hashes need no task that holds all."""

import hashlib
import os

import pytest
from helpers import entities, relations
from pyspark.sql import functions as F

from lattix.operators import audit, contract, fingerprint, resolve, traverse, verdict
from lattix.plans import bridge, catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", ["s_entity_scan", "a3_counts_by_kind", "e1_equivalence_classes", "j11_registry_edges"])
def test_queries_build_only_the_kinds_that_they_meet(spark, monkeypatch, name):
    """Before, each built the whole graph first, the flow of all orders with it."""
    monkeypatch.setattr(bridge, "_written", {})
    catalog.QUERIES[name](spark, SF).collect()
    assert not [k for k in bridge._written if k[2] == "rel"]


def test_kinds_built_one_by_one_make_the_whole_graph(spark, monkeypatch):
    monkeypatch.setattr(bridge, "_written", {})
    some = bridge.graph(spark, SF, nodes=["Method", "Skill"], edges=["WRAPS", "HAS_MODULE"])
    whole = bridge.graph(spark, SF)
    for have, part, want in zip(whole, some, bridge.build(spark, SF), strict=True):
        assert have.columns == part.columns
        assert have.exceptAll(want).isEmpty() and want.exceptAll(have).isEmpty()
        kinds = [r[0] for r in part.select("kind").distinct().collect()]
        assert part.exceptAll(want.where(want.kind.isin(kinds))).isEmpty() and want.where(want.kind.isin(kinds)).exceptAll(part).isEmpty()


def one_operation(spark, n=60):
    """Methods of one operation and one package, which allows some statistics and has some containers."""
    e = entities(spark, ("op:1", "Operation"), ("pkg:p", "Package", "p"), *((f"m:{k}", "Method", None, None, "p") for k in range(n)), *((f"stat:{k}", "StatisticalMethod") for k in range(9)), ("assum:1", "Assumption"), ("assum:2", "Assumption"))
    r = relations(
        spark, *((f"m:{k}", "PERFORMS", "op:1") for k in range(n)), *(("op:1", "AMENABLE_TO", f"stat:{k}", '{"evidence": "doi:1"}') for k in range(9)), *((f"stat:{k}", "REQUIRES_ASSUMPTION", f"assum:{k % 2 + 1}") for k in range(9)),
        *((f"ctr:{k}", "FROM_PACKAGE", "pkg:p") for k in range(9)),
    )
    return e, r


def tasks_of(df) -> int:
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_contract_rows_of_one_operation_are_spread(spark):
    """Before, they were shuffled by the names of operation and assumption, and landed in one or two tasks."""
    rows = contract.contract_rows(*one_operation(spark)).where("source = 'amenable'")
    assert rows.count() == 60 * 2 and tasks_of(rows) > 8


def test_neighbours_of_one_operation_are_spread(spark):
    rows = traverse.neighbourhood(*one_operation(spark)).where("bucket = 'amenable'")
    assert rows.count() == 60 * 9 and tasks_of(rows) > 8


def test_containers_of_one_package_are_spread(spark):
    e, r = one_operation(spark)
    rows = resolve.packaged_as(e, r)
    assert rows.count() == 60 * 9 and tasks_of(rows) > 8
    # a method with two package names that lead to the same container, and a package without one
    more = entities(spark, ("m:1", "Method", None, None, "q"), ("pkg:q", "Package", "q"), ("pkg:P", "Package", "P"), ("pkg:none", "Package", "none"), ("m:x", "Method", None, None, "None"))
    links = relations(spark, ("ctr:1", "FROM_PACKAGE", "pkg:q"), ("ctr:1", "FROM_PACKAGE", "pkg:P"))
    got = sorted(map(tuple, resolve.packaged_as(e.unionByName(more), r.unionByName(links)).where("from_id in ('m:1', 'm:x')").collect()))
    assert got == sorted([*(("m:1", f"ctr:{k}") for k in range(9)), ("m:x", "pkg:none")])


def text_of(df, *columns) -> str:
    return "\n".join(sorted(("|".join(r) for r in df.select(*columns).collect()), key=str.encode))


NODE, EDGE = ("id", "name", "kind", "properties", "bioconda_pkg", "biotools_id"), ("from_id", "to_id", "kind", "properties")


def test_fingerprints_gather_no_lines_in_one_task(spark):
    """Before, one task collected and joined all lines."""
    e, r = one_operation(spark)
    e = e.unionByName(entities(spark, ("m:é", "Method", "\U0001d11e"), ("m:\uffff", "Method", "a\nb"), ("m:1", "Method")))
    want = hashlib.sha256(f"{text_of(e, *NODE)}\n==EDGES==\n{text_of(r, *EDGE)}".encode()).hexdigest()
    got = fingerprint.graph_fingerprint(e, r)
    assert "collect_list" not in got._jdf.queryExecution().toString() and got.first()[0] == f"sha256:{want}"
    assert tuple(fingerprint.ordered_digest(fingerprint.lines_of_entities(e)).first()) == (hashlib.sha256(text_of(e, *NODE).encode()).hexdigest(), e.count())
    assert tuple(fingerprint.ordered_digest(fingerprint.lines_of_entities(e.limit(0))).first()) == (hashlib.sha256(b"").hexdigest(), 0)


def test_the_graph_fingerprint_covers_every_edge(spark):
    """Before, edges of pipelines to modules were left out."""
    e, r = bridge.build(spark, SF)
    want = hashlib.sha256(f"{text_of(e, *NODE)}\n==EDGES==\n{text_of(r, *EDGE)}".encode()).hexdigest()
    assert catalog.QUERIES["a8_graph_fingerprint"](spark, SF).first()[0] == f"sha256:{want}"


def test_edge_checks_count_each_node_of_an_id_and_shuffle_no_texts(spark):
    """Before, all columns of the relations were shuffled twice, the second time by the id of their end."""
    e = entities(spark, ("m:1", "Method"), ("m:1", "Method"), ("m:1", "Module"), ("op:1", "Operation"), ("op:1", "Operation"), ("op:2", "Data"))
    r = relations(spark, ("m:1", "PERFORMS", "op:1"), ("m:1", "PERFORMS", "op:2"), ("m:1", "PERFORMS", "gone"), ("gone", "PERFORMS", "op:1"), ("m:1", "DOWNSTREAM_OF", "m:1"), ("m:1", "USES_STATISTICAL_METHOD", "op:1", '{"evidence": "x"}'))
    got = audit.invariants(e, r)
    found = {x["name"]: x["violations"] for x in got.collect()}
    assert found["PERFORMS: endpoints"] == 2 + 3 + 3 + 2 and found["DOWNSTREAM_OF: endpoints"] == 0 and found["USES_STATISTICAL_METHOD: endpoints"] == 6
    assert found["DOWNSTREAM_OF: no self loop"] == found["DOWNSTREAM_OF: attestations"] == 9 and found["USES_STATISTICAL_METHOD: grounded"] == 6 and found["REL: provenance"] == 0
    plan = audit._edge_checks(e, r)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    aggregates = [line for line in plan.splitlines() if "Aggregate [to_id" in line]
    assert len(joins) == 2 and plan.index(joins[0]) < plan.index(aggregates[0]) < plan.index(joins[1])


def test_gates_go_by_one_sort_and_contracts_are_not_shuffled_by_assumption(spark):
    """Before, the folded rows were shuffled twice by assumption, and each window of the gates sorted them anew."""
    e, r = one_operation(spark)
    e = e.unionByName(entities(spark, ("diag:1", "Diagnostic", None, '{"checkable": "pre_run", "min_replicates_per_group": 3}')))
    r = r.unionByName(relations(spark, ("assum:1", "CHECKED_BY", "diag:1"), *((f"m:{k}", "USES_STATISTICAL_METHOD", "stat:2") for k in range(60))))
    told = spark.createDataFrame([("m:1", "replicates_per_group", 2), ("m:2", "replicates_per_group", 5), ("m:2", "other", 1), ("m:3", "other", 9)], "method_id string, key string, value long")
    some = spark.createDataFrame([("m:1",), ("m:2",)], "method_id string")
    assert {x["method_id"] for x in contract.contracts(e, r, some).collect()} == {"m:1", "m:2"}
    gates = verdict.gates(contract.contracts(e, r), told)
    results = {x["method_id"]: x["result"] for x in gates.where("key is not null").collect()}
    assert len(results) == 60 and (results["m:1"], results["m:2"], results["m:3"]) == ("FAIL", "PASS", "INSUFFICIENT_INFO")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = verdict.gates(contract.contracts(e, r), told)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    windows = [n for n, line in enumerate(plan) if " Window [" in line]
    assert len(windows) == 2 and not [x for x in plan[windows[0] : windows[1]] if "Exchange" in x or " Sort [" in x]
    assert not [x for x in plan[: windows[1] + 3] if "Exchange" in x]  # rows stay with their method from the fold on


def test_chains_make_the_verdicts_once(spark):
    assert "l_quantity" not in catalog.QUERIES["d4_chain_verdict"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_workflow_checks_make_the_steps_once(spark):
    """Before, every check numbered the lines of all orders anew."""
    plan = catalog.QUERIES["d10_workflow_issues"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert " Window [" not in plan and "lineitem" not in plan


def test_modules_are_broadcast_to_pipelines(spark):
    """Before, members were shuffled by module, a key of few values."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = catalog.QUERIES["s12_pipeline_flow"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("BroadcastHashJoin [") == 4 and "SortMergeJoin [path" not in plan and "SortMergeJoin [module_id" not in plan


def test_the_catalogue_reads_no_statistics(spark, monkeypatch):
    monkeypatch.setattr(bridge, "_written", {})
    catalog.QUERIES["d12_catalogue"](spark, SF).collect()
    assert not [k for k in bridge._written if k[2] == "rel"]


def test_frontiers_that_are_asked_again_are_cut(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(traverse, "cut", lambda df: cuts.append(df) or df)
    e, r = one_operation(spark)
    seeds = spark.createDataFrame([("assum:1",)], "id string")
    assert {x["hop"] for x in traverse.within_hops(e, r, seeds, 3).collect()} == {0, 1, 2, 3} and len(cuts) == 3
