"""Canonical JSON for the properties column: sorted keys, one blank after separators, non-ASCII escaped."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(properties: dict) -> str:
    return json.dumps(properties, sort_keys=True)


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON texts in canonical form, a batch at a time; null and what is no object become an empty one."""
    out = []
    for t in text:
        try:
            value = json.loads(t) if isinstance(t, str) else {}
        except ValueError:
            value = {}
        out.append(canonical(value if isinstance(value, dict) else {}))
    return pd.Series(out, dtype="object")


def properties(**columns: Column) -> Column:
    """Canonical JSON of columns by name; null ones are left out."""
    return canonical_json(F.to_json(F.struct(*(c.alias(n) for n, c in columns.items()))))


def raw_values(text: Column) -> Column:
    """The keys of JSON objects with their values as JSON texts, so that numbers, lists and objects stay what they are."""
    return F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, v: F.to_json(v))


def from_raw_values(values: Column) -> Column:
    """Canonical JSON of keys and JSON texts."""
    listed = lambda k: F.to_json(F.array(k))  # noqa: E731  a string as a list of one
    quoted = lambda k: F.substring(listed(k), F.lit(2), F.length(listed(k)) - 2)
    parts = F.transform(F.map_entries(values), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"]))
    return canonical_json(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
