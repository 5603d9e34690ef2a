"""The data model: one table of typed entities and one of typed, directed relations.

All columns are strings and missing values are empty strings.  ``properties`` holds canonical JSON (see
``lattix.functions.canon``).  On disk, relations are partitioned by kind, which every traversal filters on.
"""

from __future__ import annotations

from pyspark.sql import types as T

ENTITY_COLUMNS = ["id", "name", "kind", "properties", "bioconda_pkg", "biotools_id", "source", "source_url", "ingested_at"]
REL_COLUMNS = ["from_id", "to_id", "kind", "properties", "source", "source_url", "ingested_at"]
ENTITY = T.StructType([T.StructField(c, T.StringType(), False) for c in ENTITY_COLUMNS])
REL = T.StructType([T.StructField(c, T.StringType(), False) for c in REL_COLUMNS])

# The kinds of nodes and edges.
NODE_KINDS = [
    "Method", "Module", "Pipeline", "Package", "Container", "Operation", "Data", "Format", "StatisticalMethod", "Assay", "Protocol", "StudyDesign",
    "Instrument", "Material", "Assumption", "Diagnostic", "ExecutionSpec", "Modality", "Skill", "Topic", "Paper",
]
EDGE_KINDS = [
    "WRAPS", "PERFORMS", "INPUT", "OUTPUT", "PACKAGED_AS", "FROM_PACKAGE", "IS_A", "SAME_AS", "HAS_MODULE", "DOWNSTREAM_OF", "USES_STATISTICAL_METHOD",
    "REQUIRES_ASSUMPTION", "AMENABLE_TO", "CHECKED_BY", "RUNS_AS", "HAS_MODALITY", "ANALYZED_BY", "HAS_TOPIC", "HAS_FORMAT", "CITES",
]
ONTOLOGY_KINDS = ["Operation", "Topic", "Data", "Format", "StatisticalMethod", "Assumption", "Diagnostic", "Assay", "Protocol", "StudyDesign", "Material", "Instrument"]

# Which kinds an edge may join.  PACKAGED_AS may end in a Package where a build had no container to offer;
# the audit counts those as violations.
ENDPOINTS: dict[str, tuple[list[str], list[str]]] = {
    "PERFORMS": (["Method"], ["Operation"]),
    "PACKAGED_AS": (["Method"], ["Container"]),
    "WRAPS": (["Module", "Skill"], ["Method"]),
    "INPUT": (["Method"], ["Data", "Format"]),
    "OUTPUT": (["Method"], ["Data", "Format"]),
    "FROM_PACKAGE": (["Container"], ["Package"]),
    "IS_A": (ONTOLOGY_KINDS, ONTOLOGY_KINDS),
    "USES_STATISTICAL_METHOD": (["Method"], ["StatisticalMethod"]),
    "REQUIRES_ASSUMPTION": (["StatisticalMethod"], ["Assumption"]),
    "AMENABLE_TO": (["Operation"], ["StatisticalMethod"]),
    "CHECKED_BY": (["Assumption"], ["Diagnostic"]),
    "RUNS_AS": (["Module"], ["ExecutionSpec"]),
    "HAS_MODULE": (["Pipeline"], ["Module"]),
    "HAS_MODALITY": (["Pipeline"], ["Modality"]),
    "ANALYZED_BY": (["Assay"], ["Method"]),
    "DOWNSTREAM_OF": (["Method", "Module"], ["Method", "Module"]),
}
