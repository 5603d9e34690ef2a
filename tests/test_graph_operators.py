import pytest
from helpers import entities, relations
from pyspark.sql import functions as F

from lattix.graph import PropertyGraph
from lattix.operators import audit, contract, planner, resolve, traverse, verdict


@pytest.fixture(scope="module")
def graph(spark):
    e = entities(
        spark, ("m:star", "Method", "STAR", '{"description": "aligner"}', "star"), ("m:salmon", "Method", "salmon", None, "salmon"), ("m:deseq2", "Method", "DESeq2"), ("m:lone", "Method", "lone"),
        ("op:1", "Operation", "Alignment"), ("op:2", "Operation", "Differential expression"), ("data:r", "Data", "reads"), ("data:c", "Data", "counts"), ("stat:nb", "StatisticalMethod", "negative binomial"),
        ("stat:ml", "StatisticalMethod", "likelihood"), ("assum:n", "Assumption", "normality"), ("assum:i", "Assumption", "independence"), ("assum:p", "Assumption", "posterior"),
        ("diag:s", "Diagnostic", "size", '{"checkable": "pre_run", "min_replicates_per_group": 3, "applies_to_assumption": "assum:n"}'), ("diag:q", "Diagnostic", "plot", '{"checkable": "post_run"}'),
        ("mod:a", "Module", "a"), ("mod:b", "Module", "b"), ("mod:c", "Module", "c"), ("ctr:1", "Container", "img", '{"image_name": "img:1"}'), ("pkg:star", "Package", "star"), ("pipe:1", "Pipeline", "p"), ("skill:x/s", "Skill", "rna", '{"description": "rna things"}'),
    )
    r = relations(
        spark, ("m:star", "PERFORMS", "op:1"), ("m:deseq2", "PERFORMS", "op:2"), ("m:lone", "PERFORMS", "op:2"), ("m:star", "INPUT", "data:r"), ("m:star", "OUTPUT", "data:c"), ("m:deseq2", "INPUT", "data:c"), ("m:salmon", "INPUT", "data:r"),
        ("m:deseq2", "USES_STATISTICAL_METHOD", "stat:nb", '{"evidence": "doi:10/1"}'), ("op:2", "AMENABLE_TO", "stat:ml", '{"evidence": "pmid:3"}'), ("stat:nb", "REQUIRES_ASSUMPTION", "assum:n", '{"evidence": "doi:10/2"}'),
        ("stat:nb", "REQUIRES_ASSUMPTION", "assum:i", '{"evidence": ""}'), ("stat:ml", "REQUIRES_ASSUMPTION", "assum:n", '{"evidence": "isbn:1"}'), ("stat:nb", "REQUIRES_ASSUMPTION", "assum:p", '{"evidence": "url:x"}'),
        ("assum:n", "CHECKED_BY", "diag:s", '{"evidence": "doi:1"}'), ("assum:i", "CHECKED_BY", "diag:s", '{"evidence": "doi:1"}'), ("assum:p", "CHECKED_BY", "diag:q", '{"evidence": "doi:1"}'),
        ("mod:a", "WRAPS", "m:star"), ("mod:b", "WRAPS", "m:deseq2"), ("mod:b", "WRAPS", "m:salmon"), ("skill:x/s", "WRAPS", "m:deseq2"), ("skill:x/s", "WRAPS", "m:star"), ("m:star", "PACKAGED_AS", "ctr:1"), ("ctr:1", "FROM_PACKAGE", "pkg:star"),
        ("pipe:1", "HAS_MODULE", "mod:a"), ("mod:a", "DOWNSTREAM_OF", "mod:b", '{"attestations": 2, "pipelines": ["p1", "p2"], "derivation": "nextflow_dsl2"}'), ("mod:a", "DOWNSTREAM_OF", "mod:c", '{"attestations": 1, "pipelines": ["p1"], "derivation": "io_inferred"}'),
    )
    return PropertyGraph(spark, e.cache(), r.cache())


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_hops_and_induced_edges(graph):
    nodes, edges = graph.subgraph(["data:c", "gone"], 1)
    assert rows(nodes, "id") == [("data:c",), ("m:deseq2",), ("m:star",)]
    assert rows(edges) == [("m:deseq2", "data:c", "INPUT"), ("m:star", "data:c", "OUTPUT")]
    far = traverse.within_hops(graph.entity, graph.rel, graph._ids(["pkg:star"]), 6)
    assert dict(far.collect())["m:deseq2"] == 4


def test_keywords(graph):
    found = [r["id"] for r in graph.resolve_method_ids(["star", "NORMAL"]).orderBy("ord").collect()]
    assert found[0] == "m:star" and found.index("assum:n") > found.index("m:deseq2")
    assert graph.resolve_method_ids([]).collect() == [] and rows(graph.resolve_skill_ids(["rna", "THINGS"])) == [("skill:x/s",)] and graph.resolve_skill_ids([]).collect() == []
    values = graph.entity.where(traverse.matches(F.lit("description"), values_only=True)).count()
    assert values == 0 and graph.entity.where(traverse.matches(F.lit("description"))).count() == 2


def test_contract_scope_and_phase(graph):
    c = {(r["assumption_id"], r["source"]): r for r in graph.method_preconditions("m:deseq2").collect()}
    assert c["assum:n", "used"]["min_replicates_per_group"] == 3 and c["assum:i", "used"]["min_replicates_per_group"] is None  # the floor's scope
    assert c["assum:i", "used"]["checkable"] == "pre_run" and c["assum:p", "used"]["checkable"] == "post_run" and c["assum:n", "amenable"]["evidence"] == "isbn:1"
    with pytest.raises(KeyError):
        graph.method_preconditions("m:none")


@pytest.mark.parametrize(("facts", "status"), [({}, "FACTS_REQUIRED"), ({"replicates_per_group": 2}, "BLOCKED"), ({"replicates_per_group": 3}, "EVALUABLE")])
def test_verdicts(graph, facts, status):
    v, gates = graph.evaluate(method="m:deseq2", facts=facts)
    assert v.first()["status"] == status
    found = rows(gates, "assumption", "phase", F.coalesce("key", F.lit("")))
    assert found == [("independence", "pre_run", ""), ("normality", "pre_run", "replicates_per_group"), ("posterior", "post_run", "")]
    assert graph.evaluate(skill="skill:x/s", facts=facts)[0].first()["status"] == status
    assert graph.evaluate(method="m:star", facts=facts)[0].first()["status"] == "NOT_EVALUABLE"


def test_amenable_never_gates_and_presence_gates(graph, spark):
    v, gates = graph.evaluate(method="m:lone")
    assert v.first()["status"] == "EVALUABLE" and gates.first()["result"] == "REQUIRES_REVIEW"
    c = graph.contracts().where("method_id = 'm:deseq2'")
    asked = spark.createDataFrame([("m:deseq2", "assum:i", "used", "blocked_design", True)], "method_id string, assumption_id string, source string, key string, expected boolean")
    for value, result in ((1, "PASS"), (0, "FAIL"), (None, "INSUFFICIENT_INFO")):
        facts = spark.createDataFrame([("m:deseq2", "blocked_design", value)] if value is not None else [], "method_id string, key string, value long")
        got = verdict.gates(c, facts, requires=asked).where("key = 'blocked_design'").first()
        assert got["result"] == result


def test_chains(graph, spark):
    steps = spark.createDataFrame([("ok", 0, "m:star"), ("ok", 1, "m:deseq2"), ("broken", 0, "m:star"), ("broken", 1, "m:salmon"), ("new", 0, "m:none")], "chain string, ord int, method_id string")
    v = spark.createDataFrame([("m:star", "EVALUABLE"), ("m:deseq2", "EVALUABLE"), ("m:salmon", "EVALUABLE")], "method_id string, status string")
    h = verdict.handoffs(steps, graph.rel)
    chains = steps.select("chain").union(spark.createDataFrame([("empty",)], "chain string"))
    assert rows(verdict.chain_verdicts(chains, steps, v, h), "chain", "status") == [("broken", "BLOCKED"), ("empty", "EVALUABLE"), ("new", "NOT_EVALUABLE"), ("ok", "EVALUABLE")]
    unknown = verdict.handoffs(steps, graph.rel, v.where("method_id = 'm:star'"))
    assert {r["handoff"] for r in unknown.collect()} == {"UNKNOWN"}


def test_suggestions(graph):
    got = [(r["module_id"], r["count"], r["method_id"], r["container"]) for r in graph.suggest(["mod:a"]).orderBy("ord").collect()]
    assert got == [("mod:b", 2, "m:deseq2", None)]  # mod:c has nothing to run
    assert rows(graph.suggest(["data:r"]), "module_id", "count") == [("mod:a", 1), ("mod:b", 0)]
    assert graph.suggest(["mod:a"], exclude=["mod:b"]).collect() == []
    assert [r["id"] for r in planner.frontier_of_labels(graph.entity, graph.rel, ["STAR-alignment"], "data:r").orderBy("ord").collect()][0] == "data:r"


def test_validator_codes(graph, spark):
    steps = [
        ("w", 1, "s1", "m:none", "", ["a0"], ["a1"], ["op:1"]), ("w", 2, "s2", "m:star", "ctr:9", ["a0", "gone"], ["a1", "lost"], ["op:2"]), ("w", 3, "s3", "m:deseq2", "", ["a2"], ["a3"], ["op:2"]),
    ]
    art = [("w", "a0", "data:c", None), ("w", "a1", "data:r", "s1"), ("w", "a2", "", None), ("w", "a3", "data:r", "s3")]
    s = spark.createDataFrame(steps, "workflow string, step_ord int, step_id string, method_id string, container string, inputs array<string>, outputs array<string>, evidence array<string>")
    a = spark.createDataFrame(art, "workflow string, artifact_id string, format string, produced_by string")
    d = spark.createDataFrame([("w", "d", ["nope"], ["s1", ""])], "workflow string, decision_id string, inputs array<string>, leads_to array<string>")
    got = rows(planner.validate(graph.entity, graph.rel, s, a, d, allowed=graph._ids(["m:star"]), approved=graph._ids([])), "code", "subject")
    assert got == [
        ("container_not_packaged", "ctr:9"), ("decision_input_unknown", "nope"), ("decision_leads_to_unknown", ""), ("evidence_missing", "op:2"), ("input_artifact_unknown", "gone"), ("input_contract_violation", "a0"),
        ("method_not_allowed", "m:deseq2"), ("method_not_found", "m:none"), ("output_artifact_unknown", "lost"), ("output_contract_violation", "a1"), ("output_not_produced_here", "a1"),
    ]


BREAKS = {
    "PERFORMS: endpoints": ("op:1", "PERFORMS", "m:star"),
    "WRAPS: endpoints": ("m:star", "WRAPS", "mod:a"),
    "INPUT: endpoints": ("m:star", "INPUT", "gone"),
    "PACKAGED_AS: endpoints": ("m:star", "PACKAGED_AS", "pkg:star"),
    "DOWNSTREAM_OF: no self loop": ("mod:a", "DOWNSTREAM_OF", "mod:a", '{"attestations": 1, "pipelines": ["p"]}'),
    "DOWNSTREAM_OF: attestations": ("mod:b", "DOWNSTREAM_OF", "mod:c", '{"attestations": 2, "pipelines": ["p"]}'),
    "DOWNSTREAM_OF: acyclic": ("mod:b", "DOWNSTREAM_OF", "mod:a", '{"attestations": 1, "pipelines": ["p"], "derivation": "nextflow_dsl2"}'),
    "USES_STATISTICAL_METHOD: grounded": ("m:star", "USES_STATISTICAL_METHOD", "stat:nb", '{"evidence": "url:x"}'),
    "CHECKED_BY: grounded": ("assum:n", "CHECKED_BY", "diag:q"),
}


def test_each_break_fails_its_invariant(graph, spark):
    sound = graph.rel.where("not (kind = 'REQUIRES_ASSUMPTION' and properties like '%\"\"%')")
    base = {r["name"]: r["violations"] for r in audit.invariants(graph.entity, sound).collect()}
    assert set(base.values()) == {0} and len(base) >= 26
    for name, edge in BREAKS.items():
        got = {r["name"]: r["violations"] for r in audit.invariants(graph.entity, sound.unionByName(relations(spark, edge))).collect()}
        assert got[name] >= 1, name
    inferred = relations(spark, ("mod:b", "DOWNSTREAM_OF", "mod:a", '{"attestations": 1, "pipelines": ["p"], "derivation": "io_inferred"}'))
    got = {r["name"]: r["violations"] for r in audit.invariants(graph.entity, sound.unionByName(inferred)).collect()}
    assert got["DOWNSTREAM_OF: acyclic"] == 0
    twice = graph.entity.unionByName(entities(spark, ("m:star", "Method")))
    assert {r["name"]: r["ok"] for r in audit.invariants(twice, sound).collect()}["ENTITY: unique id"] is False


def test_missing_links_and_residual(graph, spark):
    links = spark.createDataFrame([("m:star", "stat:nb", "USES_STATISTICAL_METHOD", "Method", "StatisticalMethod"), ("m:gone", "stat:nb", "USES_STATISTICAL_METHOD", "Method", "StatisticalMethod")], "from_id string, to_id string, kind string, from_kind string, to_kind string")
    assert audit.missing_links(graph.entity, graph.rel, links).count() == 1
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "y")], "a string, b string")
    assert rows(audit.cycle_residual(edges)) == [("b",), ("c",), ("d",)]  # what lies behind a cycle counts too


def test_resolution(spark):
    rec = spark.createDataFrame([("x", "N", "", {"b": "2"}, 2), ("x", "n", "pkg", {"a": "1"}, 1), ("y", "y", "", {}, 3)], "id string, name string, bioconda_pkg string, props map<string,string>, src_ord int")
    m = {r["id"]: r for r in resolve.hard_merge(rec).collect()}
    assert m["x"]["name"] == "n" and m["x"]["bioconda_pkg"] == "pkg" and m["x"]["props"] == {"a": "1", "b": "2"}
    e = entities(spark, ("m:1", "Method", "N", None, "P", "R"), ("m:2", "Method", "n", None, "", "r"), ("m:3", "Method", "q", None, "p", ""), ("pkg:p", "Package", "p"), *[(f"m:k{i}", "Method", "same") for i in range(9)])
    assert rows(resolve.same_as(traverse.of_kind(e, "Method"))) == [("m:1", "m:2", 0.7, "biotools_id")]
    assert rows(resolve.large_groups(traverse.of_kind(e, "Method"), F.col("name"))) == [("same", 9)]
    none, some = relations(spark, ("a", "WRAPS", "b")), relations(spark, ("ctr:1", "FROM_PACKAGE", "pkg:p"), ("ctr:2", "FROM_PACKAGE", "pkg:p"), ("ctr:2", "FROM_PACKAGE", "pkg:p"))
    assert rows(resolve.packaged_as(e, none)) == [("m:1", "pkg:p"), ("m:3", "pkg:p")]
    assert len(rows(resolve.packaged_as(e, some))) == 4


def test_attestations_merge(spark):
    d = [("a", "b", ["p2"], 0.5, "io_inferred", 1), ("a", "b", ["p1", "p2"], 0.95, "nextflow_dsl2", 2)]
    got = resolve.merge_attestations(spark.createDataFrame(d, "from_id string, to_id string, pipelines array<string>, confidence double, derivation string, src_ord int")).first()
    assert (got["pipelines"], got["attestations"], got["confidence"], got["derivation"]) == (["p1", "p2"], 2, 0.95, "io_inferred")


def test_store_fingerprint_export(graph, spark, tmp_path):
    bad = graph.rel.unionByName(relations(spark, ("m:star", "INPUT", "gone")))
    n = PropertyGraph(spark, graph.entity, bad).save(f"{tmp_path}/g")
    assert n == {"nodes": graph.entity.count(), "edges_loaded": graph.rel.count(), "edges_dropped": 1}
    again = PropertyGraph.open(spark, f"{tmp_path}/g")
    assert again.fingerprint() == graph.fingerprint() == PropertyGraph(spark, graph.entity.repartition(5), graph.rel.repartition(3).withColumn("ingested_at", F.lit("later"))).fingerprint()
    assert again.export_kgx(f"{tmp_path}/kgx") == {"nodes": n["nodes"], "edges": n["edges_loaded"]}
    text = "".join(p.read_text() for p in (tmp_path / "kgx/nodes").glob("part-*"))
    assert text.splitlines()[0].split("\t") == ["id", "name", "category", "source", "source_url", "ingested_at"] and "m:star\tSTAR\tMethod" in text
    assert graph.catalogue().where("method_id = 'm:star'").first()["reproducibility"] == 0.8 and "STAR -[PERFORMS]-> Alignment" in graph.retrieve_context(["m:star"])
    assert graph.retrieve_context([]) == ""


def test_skill_coverage_and_diff(graph, spark):
    v = spark.createDataFrame([("m:deseq2", "BLOCKED"), ("m:star", "NOT_EVALUABLE")], "method_id string, status string")
    assert rows(audit.skill_coverage(graph.entity, graph.rel, v)) == [("skill:x/s", 2, 1, "")]
    m = lambda *r: spark.createDataFrame(list(r), "metric string, value double")
    assert rows(audit.metric_diff(m(("a", 1.0), ("b", 2.0)), m(("a", 1.0), ("b", 3.0)))) == [("b", 2.0, 3.0)]
    assert contract.evidence_sources(graph.contracts(), spark.createDataFrame([("f.yaml", "doi: 10/2")], "path string, text string")).where("evidence = 'doi:10/2'").count() == 1
