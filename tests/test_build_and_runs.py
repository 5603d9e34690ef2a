import json

import pytest
from helpers import entities, relations
from pyspark.sql import functions as F

from lattix.operators import gate, runner
from lattix.plans.build import build
from lattix.sources.manifest import read_lock
from lattix.streaming import rollup


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def parts(spark):
    flow = lambda p, d: ("mod:a", "DOWNSTREAM_OF", "mod:b", f'{{"pipelines": ["{p}"], "attestations": 1, "confidence": 0.5, "derivation": "{d}"}}')
    a = entities(spark, ("m:x", "Method", "x", '{"description": "d"}', "", "X"), ("mod:a", "Module"), ("mod:b", "Module"), ("op:1", "Operation"), ("op:2", "Operation")), relations(spark, ("mod:a", "WRAPS", "m:x"), flow("p1", "io_inferred"), ("m:x", "PERFORMS", "op:2"))
    b = entities(spark, ("m:x", "Method", "x", '{"homepage": "h"}', "x"), ("pkg:x", "Package", "x"), ("ctr:1", "Container", "img")), relations(spark, flow("p2", "io_inferred"), ("ctr:1", "FROM_PACKAGE", "pkg:x"), ("mod:a", "WRAPS", "m:gone"))
    return [a, b]


def test_build(spark, tmp_path):
    registry = spark.createDataFrame([("x", ["op:1"])], "registry_id string, operations array<string>")
    removed = spark.createDataFrame([("m:x", "op:2")], "from_id string, to_id string")
    r = build(spark, parts(spark), f"{tmp_path}/g", ingested_at="d", lock=f"{tmp_path}/lock", registry=registry, removed=removed)
    assert r["nodes"] == 7 and r["edges_dropped"] == 1 and r["failures"] == {} and read_lock(f"{tmp_path}/lock") == r
    again = build(spark, parts(spark)[::1], f"{tmp_path}/h", ingested_at="later", registry=registry, removed=removed)
    assert again["fingerprint"] == r["fingerprint"]
    rel = spark.read.parquet(f"{tmp_path}/g/rel")
    assert rows(rel, "from_id", "kind", "to_id") == [("ctr:1", "FROM_PACKAGE", "pkg:x"), ("m:x", "PACKAGED_AS", "ctr:1"), ("m:x", "PERFORMS", "op:1"), ("mod:a", "DOWNSTREAM_OF", "mod:b"), ("mod:a", "WRAPS", "m:x")]
    assert '"pipelines": ["p1", "p2"]' in rel.where("kind = 'DOWNSTREAM_OF'").first()["properties"]
    x = spark.read.parquet(f"{tmp_path}/g/entity").where("id = 'm:x'").first()
    assert x["bioconda_pkg"] == "x" and x["biotools_id"] == "X" and "description" in x["properties"] and "homepage" in x["properties"]


def test_typed_properties_order_and_escapes(spark, tmp_path):
    """Numbers, lists and objects stay what they are, sources keep their order, and names with quotes do no harm."""
    flow = lambda p, more: ("mod:a", "DOWNSTREAM_OF", "mod:b", json.dumps({"pipelines": [p], "confidence": 0.5, "derivation": "d", **more}))
    a = entities(spark, ("m:x", "Method", "x", '{"n": 3, "tags": ["a"]}'), ("mod:a", "Module", "first"), ("mod:b", "Module")), relations(spark, flow('p"1', {"note": "kept", "n": 1}))
    b = entities(spark, ("m:x", "Method", "x", '{"o": {"k": null}, "s": "3"}'), ("mod:a", "Module", "second")), relations(spark, flow("p\\2", {"note": "lost"}))
    build(spark, [a, b], f"{tmp_path}/g", ingested_at="d")
    entity, rel = spark.read.parquet(f"{tmp_path}/g/entity"), spark.read.parquet(f"{tmp_path}/g/rel")
    assert entity.where("id = 'm:x'").first()["properties"] == '{"n": 3, "o": {"k": null}, "s": "3", "tags": ["a"]}'
    assert entity.where("id = 'mod:a'").first()["name"] == "first"
    assert json.loads(rel.first()["properties"]) == {"attestations": 2, "confidence": 0.5, "derivation": "d", "pipelines": ['p"1', "p\\2"], "note": "kept", "n": 1}


ITEM = "id string, task string, goal string, given array<string>, gold struct<sequence: array<string>, next: string>"


def test_run_and_rescore(spark):
    items = spark.createDataFrame([("a", "whole", "g", [], (["m:x", "m:y"], None)), ("b", "next", "g", ["m:x"], (None, "m:y")), ("c", "next", "g", [], (None, "m:gone")), ("d", "whole", "g", [], (["m:x"], None))], ITEM)
    results = runner.run_items(items, runner.static({"a": 'so ["Y", "x", "odd"]', "b": '["x", "y"]', "c": "no list"})).cache()
    got = {r["id"]: r for r in runner.rescore(results, items, entities(spark, ("m:x", "Method"), ("m:y", "Method"))).collect()}
    assert got["a"]["answer"] == ["m:y", "m:x"] and got["a"]["unresolved"] == ["odd"] and got["a"]["f1"] == 1.0 and got["a"]["top1"] is None
    assert got["b"]["top1"] is False and got["b"]["topk"] is True and got["c"]["answer"] is None and got["c"]["gold_resolved"] is False
    assert got["d"]["error"].startswith("KeyError") and got["d"]["f1"] is None
    assert "Done so far: m:x" in runner.prompts(items).where("id = 'b'").first()["prompt"]
    assert runner.random_answer(["m:b", "m:a"], 5, 1) == runner.random_answer(["m:a", "m:b"], 5, 1)


def test_items_and_manifest(spark):
    charts = spark.createDataFrame([("p", runner.chart_of([("A", "B"), ("B", "C")])), ("q", "flowchart TB\n"), ("r", runner.chart_of([("A", "Z")]))], "item string, text string")
    modules = spark.createDataFrame([("A", "m:a"), ("B", "m:b"), ("C", "m:c")], "step string, method_id string")
    seq, outcomes = runner.build_items(charts, modules)
    assert rows(seq) == [("p", 0, "m:a"), ("p", 1, "m:b"), ("p", 2, "m:c")] and sorted((r["item"], r["reason"]) for r in outcomes.collect()) == [("p", None), ("q", "no steps"), ("r", "fewer than two methods")]
    assert tuple(runner.build_manifest(outcomes).first()) == (1, 2, 3)
    with pytest.raises(Exception, match="without a reason"):
        runner.build_manifest(outcomes.withColumn("reason", F.lit(None).cast("string"))).collect()


def test_gate(spark, tmp_path):
    from lattix.graph import PropertyGraph

    e = entities(spark, ("m:d", "Method"), ("stat:s", "StatisticalMethod"), ("assum:a", "Assumption"), ("diag:x", "Diagnostic", "x", '{"checkable": "pre_run", "min_replicates_per_group": 3}'))
    r = relations(spark, ("m:d", "USES_STATISTICAL_METHOD", "stat:s"), ("stat:s", "REQUIRES_ASSUMPTION", "assum:a"), ("assum:a", "CHECKED_BY", "diag:x"))
    g, patterns = PropertyGraph(spark, e, r), {"m:d": r"\bdeseq"}
    assert gate.decide(g, "Rscript DESeq2.R", str(tmp_path), patterns)["decision"] == "ask" and gate.decide(g, "ls", str(tmp_path), patterns) is None
    (tmp_path / "s.csv").write_text("sample,Condition\n1,a\n2,a\n3,b\n")
    assert gate.decide(g, "deseq", str(tmp_path), patterns)["decision"] == "deny"
    (tmp_path / "s.csv").write_text("sample,group\n" + "".join(f"{i},{'ab'[i % 2]}\n" for i in range(6)))
    assert gate.decide(g, "deseq", str(tmp_path), patterns) is None


def test_streaming(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    events.limit(200).write.parquet(f"{tmp_path}/in/a")
    q = rollup.attested_windows(spark, f"{tmp_path}/in/*").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == 200
    sink = rollup.merge_into(f"{tmp_path}/out")
    batch = spark.createDataFrame([("a", "b", "p1"), ("a", "b", "p2")], "from_id string, to_id string, pipeline string")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.limit(1), 1)
    assert rows(rollup.merged(spark, f"{tmp_path}/out")) == [("a", "b", 2)]
