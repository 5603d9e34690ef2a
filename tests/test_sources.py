import pytest
from helpers import entities

from lattix.operators import evalkit
from lattix.sources import curated, manifest, modules, owl, pipelines, recipes, registry, skills, tsv


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_ontology_table(spark, tmp_path):
    head = "Class ID\tPreferred Label\tParents\tObsolete\tSynonyms\n"
    body = "http://e/operation_1\tRoot\t\tFALSE\tb| a |b\nhttp://e/operation_2\tLeaf\thttp://e/operation_1 http://e/operation_9\tFALSE\t\nhttp://e/operation_3\tOld\thttp://e/operation_1\tTRUE\t\nhttp://e/topic_1\tT\t\tFALSE\t\nhttp://e/data_1\t\t\tFALSE\t\n"
    (tmp_path / "a.tsv").write_text(head + body)
    e, r = tsv.parse_ontology_table(spark, str(tmp_path / "a.tsv"), ingested_at="d")
    assert rows(e, "id", "kind") == [("op:operation_1", "Operation"), ("op:operation_2", "Operation")]
    assert e.where("id = 'op:operation_1'").first()["properties"] == '{"synonyms": ["a", "b"], "uri": "http://e/operation_1"}'
    assert rows(r, "from_id", "to_id", "kind") == [("op:operation_2", "op:operation_1", "IS_A")]
    (tmp_path / "b.tsv").write_text("Class ID\tObsolete\nx\ty\n")
    with pytest.raises(ValueError, match="Preferred Label"):
        tsv.parse_ontology_table(spark, str(tmp_path / "b.tsv"), ingested_at="d")


def test_owl(spark, tmp_path):
    x = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:o="http://o/">
    <owl:Class rdf:about="http://p/R_1"><rdfs:label>root</rdfs:label></owl:Class>
    <owl:Class rdf:about="http://p/A_1"><rdfs:label>old</rdfs:label><owl:deprecated>true</owl:deprecated><rdfs:subClassOf rdf:resource="http://p/R_1"/></owl:Class>
    <owl:Class rdf:about="http://p/B_1"><rdfs:label>b</rdfs:label><o:hasExactSynonym>bee</o:hasExactSynonym><rdfs:subClassOf rdf:resource="http://p/A_1"/><rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf></owl:Class>
    <owl:Class rdf:about="http://p/C_1"><rdfs:label>c</rdfs:label><rdfs:subClassOf rdf:resource="http://p/B_1"/></owl:Class>
    <owl:Class rdf:about="http://p/D_1"><rdfs:label>other</rdfs:label></owl:Class></rdf:RDF>"""
    (tmp_path / "o.owl").write_text(x)
    e, r = owl.parse_ontology(spark, str(tmp_path / "o.owl"), {"R_1": "Assay"}, ingested_at="d", source="OBI", source_url="u")
    assert rows(e, "id", "kind") == [("obo:B_1", "Assay"), ("obo:C_1", "Assay"), ("obo:R_1", "Assay")] and '"bee"' in e.where("id = 'obo:B_1'").first()["properties"]
    assert rows(r, "from_id", "to_id") == [("obo:C_1", "obo:B_1")]


def test_modules(spark, tmp_path):
    def put(path, text, env=None):
        d = tmp_path / "nf-core" / path
        d.mkdir(parents=True)
        (d / "meta.yml").write_text(text)
        if env:
            (d / "environment.yml").write_text(env)

    put("bcftools/sort", "name: bcftools_sort\ntools:\n  - sort:\n      edam_operations: ['http://e/operation_3']\n      identifier: biotools:bcftools\ninput:\n  - - x: {pattern: '*.vcf'}\noutput:\n  - y: {pattern: '*.own'}\n", "dependencies: ['bioconda::bcftools=1.2']\n")
    put("two", "name: two\ntools:\n  - a: {identifier: a}\n  - B: {identifier: a}\n")
    put("broken", "name: [\n")
    t = modules.read_modules(spark, str(tmp_path))
    e, r, skipped = modules.build_modules(t, ingested_at="d")
    assert rows(e, "id", "bioconda_pkg", "biotools_id") == [("fmt:pat:.own", "", ""), ("m:a", "", "a"), ("m:b", "", ""), ("m:bcftools", "bcftools", "bcftools"), ("mod:bcftools_sort", "", ""), ("mod:two", "", "")]
    assert rows(r, "from_id", "kind", "to_id") == [
        ("m:bcftools", "INPUT", "fmt:format_3016"), ("m:bcftools", "OUTPUT", "fmt:pat:.own"), ("m:bcftools", "PERFORMS", "op:operation_3"), ("mod:bcftools_sort", "WRAPS", "m:bcftools"), ("mod:two", "WRAPS", "m:a"), ("mod:two", "WRAPS", "m:b"),
    ]
    assert skipped.count() == 1 and ("package", "bcftools") in rows(registry.wanted_ids(t.where("error is null")))


def test_registries(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"name": "salmon", "versions": [{"meta_version": "1", "images": [{"image_name": "q/salmon:1", "registry": "q"}, {"registry": "x"}]}]}')
    e, r = registry.parse_containers(spark, str(tmp_path / "c.json"), ingested_at="d")
    assert rows(e, "id", "kind") == [("ctr:q/salmon:1", "Container"), ("pkg:salmon", "Package")] and rows(r, "from_id", "to_id") == [("ctr:q/salmon:1", "pkg:salmon")]
    d = tmp_path / "r"
    d.mkdir()
    (d / "a.json").write_text('{"biotoolsID": "STAR", "function": [{"operation": [{"uri": "http://e/operation_2"}, {"uri": "http://e/operation_1"}, {"uri": "http://e/topic_1"}]}]}')
    (d / "b.json").write_text('{"biotoolsID": "star", "function": [{"operation": [{"uri": "http://e/operation_5"}]}]}')
    (d / "c.json").write_text("{broken")
    assert rows(registry.parse_registry(spark, str(d))) == [("star", ["op:operation_5"])]


def test_pipelines(spark, tmp_path):
    d = tmp_path / "mini"
    d.mkdir()
    (d / "modules.json").write_text('{"repos": {"u": {"modules": {"o": {"a": {}, "b": {}, "ghost": {}}}}}}')
    metas = spark.createDataFrame([("a", "mod:a"), ("b", "mod:b")], "path string, module_id string")
    io = (spark.createDataFrame([("mod:a", "x")], "module_id string, data string"), spark.createDataFrame([("mod:b", "x")], "module_id string, data string"))
    members, wiring = pipelines.parse_pipelines(pipelines.read_membership(spark, str(tmp_path)), metas, module_io=io)
    assert rows(members) == [("mini", "mod:a"), ("mini", "mod:b")] and rows(wiring) == [("mini", "mod:a", "mod:b", "io_inferred", 0.5)]
    charts = spark.createDataFrame([("mini", "v1([A])\nv2([B])\nv1 --> v2\n")], "pipeline string, text string")
    names = spark.createDataFrame([("mini", "A", "mod:a"), ("mini", "B", "mod:b")], "pipeline string, process string, module_id string")
    _, wiring = pipelines.parse_pipelines(members.select("pipeline", "module_id").withColumnRenamed("module_id", "path"), metas, charts, names, module_io=io)
    assert rows(wiring) == [("mini", "mod:a", "mod:b", "nextflow_dsl2", 0.95)]


def test_recipes_and_skills(spark, tmp_path):
    (tmp_path / "main.nf").write_text("process A {\n  container 'q.io/x:1'\n  script:\n  template 'run.R'\n}\n")
    r = recipes.read_recipes(spark, str(tmp_path))
    from pyspark.sql import functions as F

    specs, skipped = recipes.build_specs(r.withColumn("module_id", F.lit("mod:a")).unionByName(r.withColumn("module_id", F.lit("mod:z"))), entities(spark, ("mod:a", "Module")))
    assert rows(specs, "spec_id", "image") == [("exec:a", "q.io/x:1")] and rows(skipped) == [("mod:z", "module missing")]
    (tmp_path / "SKILL.md").write_text("---\nname: rna\ntools: [STAR, other]\n---\nalso salmon.\n")
    s = skills.read_skills(spark, str(tmp_path), {"salmon"}, library="lib")
    wraps, unwired = skills.wire_skills(s, entities(spark, ("m:star", "Method")))
    assert rows(wraps) == [("skill:lib/rna", "m:star", "STAR", "name")] and rows(unwired) == [("skill:lib/rna", "other")] and '"context_tools": ["salmon"]' in s.first()["properties"]


def test_curated(spark):
    good = {"from": "m:a", "to": "stat:x", "confidence": "high", "evidence": {"doi": "10/1", "pmid": "3"}, "quote": "q"}
    links = curated.load_links([good])
    assert links == [("m:a", "stat:x", '{"basis": "curated", "confidence": 1.0, "evidence": "doi:10/1", "quote": "q"}', "https://doi.org/10/1")]
    assert curated.load_links([{k: v for k, v in good.items() if k != "confidence"}]) == links  # a link without a word is sure
    for bad in ([good, good], [{**good, "to": ""}], [{**good, "evidence": {"url": "u"}}], [{**good, "confidence": "sure"}]):
        with pytest.raises(ValueError):
            curated.load_links(bad)
    more = curated.load_links([{**good, "from": x} for x in ("m:b", "stat:x")] + [{**good, "to": x} for x in ("stat:y", "m:a")])
    _, rel, skipped = curated.emit_links(spark, "method_statistics", [*links, *more], entities(spark, ("m:a", "Method"), ("stat:x", "StatisticalMethod")), ingested_at="d")
    assert rows(rel, "from_id", "kind", "to_id") == [("m:a", "USES_STATISTICAL_METHOD", "stat:x")]
    assert rows(skipped) == [("m:a", "m:a", "target_wrong_kind:Method"), ("m:a", "stat:y", "target_missing"), ("m:b", "stat:x", "method_missing"), ("stat:x", "stat:x", "method_wrong_kind:StatisticalMethod")]
    d = {"checks": ["n"], "ref": "doi:1", "checkable": "pre_run", "applies_to_assumption": "assum:n", "min_replicates_per_group": 3}
    (one,) = curated.load_diagnostics({"diagnostics": {"x": d}})
    assert one["id"] == "diag:x" and one["checks"] == ["assum:n"] and one["scope"] == "assum:n" and one["min_replicates_per_group"] == 3
    for k, v in (("checks", []), ("checks", "n"), ("ref", "see there"), ("checkable", "later"), ("applies_to_assumption", "z"), ("min_replicates_per_group", True), ("min_peptides_per_protein", 0)):
        with pytest.raises(ValueError):
            curated.load_diagnostics({"diagnostics": {"x": {**d, k: v}}})
    types = {"t": {"edam": "data_1"}}
    assert curated.load_tool_io({"data_types": types, "tool_io": {"a": {"consumes": ["t"], "produces": ["t"]}}}) == [("m:a", "INPUT", "data:data_1"), ("m:a", "OUTPUT", "data:data_1")]
    assert curated.load_operation_edits({"methods": {"a": {"add": ["o"], "remove": ["op:p"]}}}) == ([("m:a", "op:o")], [("m:a", "op:p")])
    assert curated.load_modalities({"modalities": {"k": {"name": "K"}}, "pipelines": {"p": ["k"], "q": None}})[1] == [("pipe:p", "modality:k")]
    term = {"assumptions": [{"id": "assum:n", "name": "N"}], "requires": [{"statistical_method": "stat:x", "assumption": "assum:n", "evidence": "doi:1"}]}
    assert [len(x) for x in curated.load_assumptions(term)] == [0, 1, 1]
    for f, bad in (
        (curated.load_tool_io, {"data_types": types, "tool_io": {"a": {"consumes": "t"}}}), (curated.load_tool_io, {"tool_io": {"a": {}}}), (curated.load_tool_io, {"tool_io": {"a": {"consumes": ["t"]}}}), (curated.load_tool_io, {"data_types": {"t": {}}}),
        (curated.load_operation_edits, {"methods": {"a": {}}}), (curated.load_modalities, {"modalities": {"k": {}}}), (curated.load_modalities, {"pipelines": {"p": ["z"]}}), (curated.load_modalities, {"modalities": {"k": {"name": "K"}}, "pipelines": {"p": "k"}}),
        (curated.load_assumptions, {**term, "assumptions": []}), (curated.load_assumptions, {**term, "assumptions": term["assumptions"] * 2}), (curated.load_assumptions, {**term, "requires": term["requires"] * 2}), (curated.load_assumptions, {**term, "requires": [{**term["requires"][0], "evidence": ""}]}),
    ):
        with pytest.raises(ValueError):
            f(bad)


def test_manifests(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("sources: {ontology: a.tsv, modules: gone}\npipelines: [{name: p, revision: '1'}]\n")
    m = manifest.load_manifest(str(tmp_path / "m.yaml"))
    with pytest.raises(FileNotFoundError, match="a.tsv.*gone"):
        manifest.resolve_sources(m, str(tmp_path))
    (tmp_path / "n.yaml").write_text("sources: {what: x}\n")
    with pytest.raises(ValueError, match="what"):
        manifest.load_manifest(str(tmp_path / "n.yaml"))
    (tmp_path / "f").write_text("x")
    good = manifest.file_digest(tmp_path / "f")
    assert manifest.verify_snapshots(str(tmp_path), {"f": good, "g": "1", "h": ""}) == [("g", "1", "MISSING")]
    manifest.write_lock(str(tmp_path / "l"), {"b": 1, "a": 2})
    assert manifest.read_lock(str(tmp_path / "l")) == {"a": 2, "b": 1} and manifest.read_lock(str(tmp_path / "none")) is None
    (tmp_path / "items").mkdir()
    (tmp_path / "items/i.json").write_text('[{"id": "b", "gold": {"sequence": ["x"]}}, {"id": "a"}]')
    assert [r["id"] for r in manifest.load_items(spark, str(tmp_path / "items")).collect()] == ["a", "b"]


def test_scoring_a_gold_answer_gives_one(spark):
    seq = spark.createDataFrame([("i", 0, "m:a"), ("i", 1, "m:b"), ("j", 0, "m:a"), ("j", 1, "m:c")], "item string, pos int, method_id string")
    same = spark.createDataFrame([("m:b", "m:c")], "a string, b string")
    assert {r["f1"] for r in evalkit.selection(seq, seq, evalkit.matched(seq, seq, same)).collect()} == {1.0}
    other = spark.createDataFrame([("i", 0, "m:c")], "item string, pos int, method_id string")
    got = {r["item"]: r["f1"] for r in evalkit.selection(seq, other, evalkit.matched(seq, other, same)).collect()}
    assert abs(got["i"] - 2 / 3) < 1e-9 and got["j"] == 0.0
    names = spark.createDataFrame([("i", 0, "Sam Tools"), ("i", 1, "fast-qc"), ("i", 2, "nothing")], "item string, pos int, name string")
    res = evalkit.resolve_names(names, entities(spark, ("m:samtools", "Method"), ("m:fastqc", "Method")), {"fast qc": "fastqc"})
    assert rows(res, "pos", "method_id") == [(0, "m:samtools"), (1, "m:fastqc"), (2, None)]
