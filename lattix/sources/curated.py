"""Curated layers: small YAML files, checked when they are read and grounded in the graph by joins.

A loader takes what a file holds and returns rows, or raises ``ValueError`` naming the record that breaks a rule.  An
``emit_`` function turns rows into (entity, rel, skipped): only what both ends of a link support becomes an edge, nodes
are made for what an edge needs and the graph lacks, and every row left out is in ``skipped`` with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.functions.canon import canonical
from lattix.operators.resolve import ground_links
from lattix.operators.traverse import of_kind
from lattix.schema import ENTITY, REL

# How sure the words are, what evidence may begin with, and the floors that a diagnostic may set.
CONFIDENCE = {"high": 1.0, "medium": 0.8, "low": 0.6}
EVIDENCE = ("doi:", "pmid:", "url:", "isbn:")
FLOORS = ("min_replicates_per_group", "min_peptides_per_protein")
#: Layers of links: the file, the keys of both ends, the edge's kind and the kinds of its ends.
LAYERS = {
    "method_statistics": ("method_statistical_methods.yaml", "method", "statistical_method", "USES_STATISTICAL_METHOD", "Method", "StatisticalMethod"),
    "operation_statistics": ("operation_amenable_statistics.yaml", "operation", "statistical_method", "AMENABLE_TO", "Operation", "StatisticalMethod"),
    "assay_methods": ("assay_methods.yaml", "assay", "method", "ANALYZED_BY", "Assay", "Method"),
}
ASSUMPTIONS, DIAGNOSTICS, DATA_TYPES, OPERATIONS, MODALITIES = "statistical_method_assumptions.yaml", "assumption_diagnostics.yaml", "data_types.yaml", "method_operations.yaml", "modalities.yaml"


def read_yaml(spark: SparkSession, folder: str, name: str) -> dict:
    """A curated file, read where Spark reads; it holds some hundred records."""
    import yaml

    data = yaml.safe_load(spark.read.text(f"{folder}/{name}", wholetext=True).first()[0]) or {}
    _need(isinstance(data, dict), "a mapping is needed", name)
    return data


def _need(ok, what: str, record) -> None:
    if not ok:
        raise ValueError(f"{what}: {record}")


def _text(value) -> str:
    return str(value or "").strip()


def _prefixed(prefix: str, value) -> str:
    return _text(value) if _text(value).startswith(prefix) else prefix + _text(value)


def _mapping(data, what: str) -> dict:
    _need(isinstance(data, dict), "a mapping is needed", what)
    return data


def _names(values, record) -> list[str]:
    _need(values is None or isinstance(values, list), "a list is needed", record)
    return values or []


def evidence_token(record: dict) -> str:
    """``doi:`` before ``pmid:`` before ``url:``, empty without."""
    return next((f"{k}:{_text(record[k])}" for k in ("doi", "pmid", "url") if _text(record.get(k))), "")


def evidence_url(record: dict) -> str:
    """The address of a publication: its own, else that of its identifier."""
    doi, pmid = _text(record.get("doi")), _text(record.get("pmid"))
    return _text(record.get("url")) or (f"https://doi.org/{doi}" if doi else f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/" if pmid else "")


def token_url(token: str) -> str:
    kind, _, rest = token.partition(":")
    return evidence_url({kind: rest}) if kind in ("doi", "pmid", "url") else ""


def _edge_properties(r: dict, evidence: str) -> str:
    word = _text(r.get("confidence") or "high").lower()
    _need(word in CONFIDENCE, "unknown confidence", r)
    return canonical({"confidence": CONFIDENCE[word], "basis": "curated", "evidence": evidence} | {k: _text(r[k]) for k in ("quote", "note") if r.get(k)})


def load_links(records: list[dict], start: str = "from", end: str = "to") -> list[tuple[str, str, str, str]]:
    """(from_id, to_id, properties, url) of links with ends, a publication as evidence and a confidence word."""
    out, seen = [], set()
    for r in _names(records, "links"):
        _mapping(r, r)
        ends, e = (_text(r.get(start)), _text(r.get(end))), _mapping(r.get("evidence") or {}, r)
        _need(all(ends), "a link needs both ends", r)
        _need(_text(e.get("doi")) or _text(e.get("pmid")), "a link needs a publication", r)
        _need(ends not in seen, "a link is there twice", r)
        seen.add(ends)
        out.append((*ends, _edge_properties(r, evidence_token(e)), evidence_url(e)))
    return out


def load_assumptions(data: dict) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(statistics, vocabulary, links): nodes (id, name, properties, url) of statistics and of assumptions, and links
    (statistic, assumption, properties, url), whose assumptions are in the vocabulary and whose evidence is a token."""

    def nodes(key: str, basis: dict) -> list[tuple]:
        out: dict[str, tuple] = {}
        for r in _names(data.get(key), key):
            _need(isinstance(r, dict) and _text(r.get("id")) and _text(r.get("name")), "an id and a name are needed", r)
            _need(_text(r["id"]) not in out, "an id is there twice", r)
            props = basis | {k: _text(r[k]) for k in ("definition", "reference") if r.get(k)}
            out[_text(r["id"])] = (_text(r["id"]), _text(r["name"]), canonical(props), token_url(_text(r.get("reference"))))
        return sorted(out.values())

    statistics, vocabulary = nodes("statistical_methods", {"basis": "curated"}), nodes("assumptions", {})
    known, links = {v[0] for v in vocabulary}, {}
    for r in _names(data.get("requires"), "requires"):
        _mapping(r, r)
        ends, evidence = (_text(r.get("statistical_method")), _text(r.get("assumption"))), _text(r.get("evidence"))
        _need(all(ends), "a requirement needs both ends", r)
        _need(ends[1] in known, "unknown assumption", r)
        _need(evidence, "a requirement needs evidence", r)
        _need(ends not in links, "a requirement is there twice", r)
        links[ends] = (*ends, _edge_properties(r, evidence), _text(r.get("source_url")) or token_url(evidence))
    return statistics, vocabulary, list(links.values())


def load_diagnostics(data: dict) -> list[dict]:
    """Diagnostics by id: id, name, form, how, checks, ref, checkable, scope and floors."""
    out = []
    for slug, r in _mapping(data.get("diagnostics") or {}, "diagnostics").items():
        r = _mapping(r or {}, slug)
        checks = [_prefixed("assum:", c) for c in _names(r.get("checks"), slug)]
        scope = _prefixed("assum:", r["applies_to_assumption"]) if r.get("applies_to_assumption") else ""
        _need(checks, "a diagnostic needs checks", slug)
        _need(_text(r.get("ref")).startswith(EVIDENCE), "a diagnostic needs evidence", slug)
        _need(_text(r.get("checkable")) in ("", "pre_run", "post_run"), "unknown phase", slug)
        _need(not scope or scope in checks, "the scope is not among the checks", slug)
        for k in FLOORS:
            v = r.get(k)
            _need(v is None or (isinstance(v, int) and not isinstance(v, bool) and v > 0), "a floor is a positive number", slug)
        out.append({"id": _prefixed("diag:", slug), "name": _text(r.get("name", slug)), "form": _text(r.get("kind", "test")), "how": _text(r.get("how")), "checks": checks, "ref": _text(r["ref"]), "checkable": _text(r.get("checkable")), "scope": scope} | {k: r.get(k) for k in FLOORS})
    return sorted(out, key=lambda d: d["id"])


def load_tool_io(data: dict) -> list[tuple[str, str, str]]:
    """(method_id, kind, data_id) of what tools consume and produce, by the keys of the file's own catalogue of data types."""
    catalogue = {}
    for key, r in _mapping(data.get("data_types") or {}, "data_types").items():
        _need(isinstance(r, dict) and r.get("edam"), "a data type needs its ontology id", key)
        catalogue[key] = _prefixed("data:", r["edam"])
    out = set()
    for method, io in _mapping(data.get("tool_io") or {}, "tool_io").items():
        io = _mapping(io or {}, method)
        _need(io.get("produces") or io.get("consumes"), "neither side is declared", method)
        for side, kind in (("produces", "OUTPUT"), ("consumes", "INPUT")):
            values = _names(io.get(side), method)
            _need(set(values) <= set(catalogue), "unknown data type", method)
            out |= {(_prefixed("m:", method), kind, catalogue[v]) for v in values}
    return sorted(out)


def load_operation_edits(data: dict) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(added, removed) pairs of method and operation; every method has one or the other."""
    edits = {"add": set(), "remove": set()}
    for m, r in _mapping(data.get("methods") or {}, "methods").items():
        r = _mapping(r or {}, m)
        _need(r.get("add") or r.get("remove"), "neither add nor remove", m)
        for k, pairs in edits.items():
            pairs |= {(_prefixed("m:", m), _prefixed("op:", o)) for o in _names(r.get(k), m)}
    return sorted(edits["add"]), sorted(edits["remove"])


def load_modalities(data: dict) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """Modalities (id, name, properties) and the pairs of pipeline and modality; pipelines list known ones."""
    catalogue, pairs = {}, set()
    for k, m in _mapping(data.get("modalities") or {}, "modalities").items():
        _need(isinstance(m, dict) and m.get("name"), "a modality needs a name", k)
        catalogue[k] = (f"modality:{k}", str(m["name"]), canonical({"description": _text(m.get("description"))}))
    for p, keys in _mapping(data.get("pipelines") or {}, "pipelines").items():
        _need(set(_names(keys, p)) <= set(catalogue), "unknown modality", p)
        pairs |= {(_prefixed("pipe:", p), f"modality:{k}") for k in keys or []}
    return sorted(catalogue.values()), sorted(pairs)


Emitted = tuple[DataFrame, DataFrame, DataFrame]


def _tail(url: Column, ingested_at: str) -> list[Column]:
    return [F.lit("curated").alias("source"), F.coalesce(F.nullif(url, F.lit("")), F.lit("curated files")).alias("source_url"), F.lit(ingested_at).alias("ingested_at")]


def _nodes(df: DataFrame, kind: str, ingested_at: str) -> DataFrame:
    """(id, name, properties, url) rows as entities."""
    return df.select("id", "name", F.lit(kind).alias("kind"), "properties", F.lit("").alias("bioconda_pkg"), F.lit("").alias("biotools_id"), *_tail(F.col("url"), ingested_at))


def _edges(df: DataFrame, kind: Column, ingested_at: str) -> DataFrame:
    return df.select("from_id", "to_id", kind.alias("kind"), "properties", *_tail(F.col("url"), ingested_at))


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENTITY)


def _grounded(links: DataFrame, entity: DataFrame, start: str, end: str, words: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Links whose ends are there and of the right kind, and (from_id, to_id, kind, skipped) of the others; ``words`` name the ends."""
    x = ground_links(links, entity, start, end)
    reason = F.regexp_replace(F.regexp_replace(F.regexp_replace("skipped", "^from_", f"{words[0]}_"), "^to_missing", f"{words[1]}_missing"), "^to_", "target_")
    x = x.withColumn("skipped", reason)
    return x.where("skipped is null"), x.where("skipped is not null").select("from_id", "to_id", "skipped")


def emit_links(spark: SparkSession, layer: str, links: list[tuple[str, str, str, str]], entity: DataFrame, *, ingested_at: str) -> Emitted:
    _, start, _, kind, a, b = LAYERS[layer]
    rows = spark.createDataFrame(links, "from_id string, to_id string, properties string, url string")
    good, skipped = _grounded(rows, entity, a, b, (start, "target"))
    return _empty(spark), _edges(good, F.lit(kind), ingested_at), skipped


def emit_statistics(spark: SparkSession, statistics: list[tuple], *, ingested_at: str) -> DataFrame:
    """Curated statistics as entities; they come before all links, which may end in them."""
    return _nodes(spark.createDataFrame(statistics, "id string, name string, properties string, url string"), "StatisticalMethod", ingested_at)


def emit_assumptions(spark: SparkSession, vocabulary: list[tuple], links: list[tuple], entity: DataFrame, *, ingested_at: str) -> Emitted:
    """Requirements of statistics that are there, and the assumptions among their ends that the graph doesn't have yet."""
    rows = spark.createDataFrame(links, "from_id string, to_id string, properties string, url string")
    have = entity.select("id", "kind")
    x = rows.join(have.withColumnRenamed("id", "from_id"), "from_id", "left")
    x = x.withColumn("skipped", F.when(F.col("kind").isNull(), "method_missing").when(F.col("kind") != "StatisticalMethod", F.concat(F.lit("method_wrong_kind:"), "kind")))
    good = x.where("skipped is null")
    terms = spark.createDataFrame(vocabulary, "id string, name string, properties string, url string")
    new = terms.join(good.select(F.col("to_id").alias("id")), "id", "left_semi").join(have, "id", "left_anti")
    return _nodes(new, "Assumption", ingested_at), _edges(good, F.lit("REQUIRES_ASSUMPTION"), ingested_at), x.where("skipped is not null").select("from_id", "to_id", "skipped")


_DIAGNOSTIC = "id string, name string, form string, how string, checks array<string>, ref string, checkable string, scope string, " + ", ".join(f"{k} long" for k in FLOORS)


def emit_diagnostics(spark: SparkSession, diagnostics: list[dict], entity: DataFrame, *, ingested_at: str) -> Emitted:
    """Diagnostics that check an assumption of the graph, with CHECKED_BY edges from those; a scope is kept only where its
    assumption is there."""
    from lattix.functions.canon import properties

    rows = spark.createDataFrame([tuple(d[c.split()[0]] for c in _DIAGNOSTIC.split(", ")) for d in diagnostics], _DIAGNOSTIC)
    assumptions = of_kind(entity, "Assumption").select(F.col("id").alias("from_id")).distinct()
    each = rows.select(F.explode("checks").alias("from_id"), F.col("id").alias("to_id"), "ref").distinct()
    good = each.join(assumptions, "from_id", "left_semi")
    skipped = each.join(assumptions, "from_id", "left_anti").select("from_id", "to_id", F.lit("assumption_missing").alias("skipped"))
    present = good.groupBy(F.col("to_id").alias("id")).agg(F.collect_set("from_id").alias("present"))
    x = rows.join(present, "id")
    some = lambda c: F.nullif(c, F.lit(""))
    scope = F.when(F.array_contains("present", F.col("scope")), F.col("scope"))
    props = properties(form=F.col("form"), how=F.col("how"), checkable=some(F.col("checkable")), applies_to_assumption=scope, **{k: F.col(k) for k in FLOORS})
    nodes = _nodes(x.select("id", "name", props.alias("properties"), F.lit("").alias("url")), "Diagnostic", ingested_at)
    edges = good.select("from_id", "to_id", properties(evidence=F.col("ref"), basis=F.lit("curated")).alias("properties"), F.lit("").alias("url"))
    return nodes, _edges(edges, F.lit("CHECKED_BY"), ingested_at), skipped


def _basis(spark: SparkSession, pairs: list[tuple], columns: str) -> DataFrame:
    return spark.createDataFrame(pairs, columns).select("*", F.lit(canonical({"basis": "curated"})).alias("properties"), F.lit("").alias("url"))


def emit_tool_io(spark: SparkSession, io: list[tuple[str, str, str]], entity: DataFrame, *, ingested_at: str) -> Emitted:
    good, skipped = _grounded(_basis(spark, io, "from_id string, edge string, to_id string"), entity, "Method", "Data", ("method", "data"))
    return _empty(spark), _edges(good, F.col("edge"), ingested_at), skipped


def emit_operation_edits(spark: SparkSession, added: list[tuple[str, str]], entity: DataFrame, *, ingested_at: str) -> Emitted:
    good, skipped = _grounded(_basis(spark, added, "from_id string, to_id string"), entity, "Method", "Operation", ("method", "operation"))
    return _empty(spark), _edges(good, F.lit("PERFORMS"), ingested_at), skipped


def emit_modalities(spark: SparkSession, modalities: list[tuple], pairs: list[tuple[str, str]], entity: DataFrame, *, ingested_at: str) -> Emitted:
    """Modalities of the pipelines that are there."""
    rows = _basis(spark, pairs, "from_id string, to_id string")
    pipelines = of_kind(entity, "Pipeline").select(F.col("id").alias("from_id")).distinct()
    good = rows.join(pipelines, "from_id", "left_semi")
    skipped = rows.join(pipelines, "from_id", "left_anti").select("from_id", "to_id", F.lit("pipeline_missing").alias("skipped"))
    named = spark.createDataFrame(modalities, "id string, name string, properties string").withColumn("url", F.lit(""))
    return _nodes(named.join(good.select(F.col("to_id").alias("id")), "id", "left_semi"), "Modality", ingested_at), _edges(good, F.lit("HAS_MODALITY"), ingested_at), skipped


def emit_all(spark: SparkSession, folder: str, entity: DataFrame, *, ingested_at: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entity, rel, skipped, removed) of all curated files of a folder: what they add to the graph, what they could not, and
    the (from_id, to_id) operations that they take away."""
    statistics, vocabulary, requires = load_assumptions(read_yaml(spark, folder, ASSUMPTIONS))
    stats = emit_statistics(spark, statistics, ingested_at=ingested_at).join(entity.select("id"), "id", "left_anti").select(ENTITY.names)
    seen = entity.select(ENTITY.names).unionByName(stats)
    parts = [emit_links(spark, layer, load_links(read_yaml(spark, folder, about[0]).get("links"), *about[1:3]), seen, ingested_at=ingested_at) for layer, about in LAYERS.items()]
    parts.append(emit_assumptions(spark, vocabulary, requires, seen, ingested_at=ingested_at))
    parts.append(emit_diagnostics(spark, load_diagnostics(read_yaml(spark, folder, DIAGNOSTICS)), seen.unionByName(parts[-1][0]), ingested_at=ingested_at))
    parts.append(emit_tool_io(spark, load_tool_io(read_yaml(spark, folder, DATA_TYPES)), seen, ingested_at=ingested_at))
    added, removed = load_operation_edits(read_yaml(spark, folder, OPERATIONS))
    parts.append(emit_operation_edits(spark, added, seen, ingested_at=ingested_at))
    parts.append(emit_modalities(spark, *load_modalities(read_yaml(spark, folder, MODALITIES)), seen, ingested_at=ingested_at))
    nodes, rel, skipped = stats, spark.createDataFrame([], REL), None
    for e, r, s in parts:
        nodes, rel = nodes.unionByName(e), rel.unionByName(r)
        skipped = s if skipped is None else skipped.unionByName(s)
    return nodes, rel, skipped, spark.createDataFrame(removed, "from_id string, to_id string")
