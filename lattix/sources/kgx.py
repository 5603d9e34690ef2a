"""Exchange format: tab-separated nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.functions.text import sanitised


def kgx_nodes(entity: DataFrame) -> DataFrame:
    cols = {"id": "id", "name": "name", "category": "kind", "source": "source", "source_url": "source_url", "ingested_at": "ingested_at"}
    return entity.select(*(sanitised(F.col(c)).alias(n) for n, c in cols.items()))


def kgx_edges(rel: DataFrame) -> DataFrame:
    cols = {"subject": "from_id", "predicate": "kind", "object": "to_id", "source": "source", "source_url": "source_url", "ingested_at": "ingested_at"}
    return rel.select(*(sanitised(F.col(c)).alias(n) for n, c in cols.items()))


def export_kgx(entity: DataFrame, rel: DataFrame, path: str, *, files: int = 1) -> dict[str, int]:
    """Write ``nodes`` and ``edges`` folders, sorted, and return the row counts."""
    counts = {}
    for name, df, order in (("nodes", kgx_nodes(entity), ["id"]), ("edges", kgx_edges(rel), ["subject", "predicate", "object"])):
        out = df.repartitionByRange(files, *order).sortWithinPartitions(*order)
        options = {"sep": "\t", "escape": '"', "emptyValue": "", "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        out.write.mode("overwrite").options(**options).csv(f"{path}/{name}")
        counts[name] = df.count()
    return counts
