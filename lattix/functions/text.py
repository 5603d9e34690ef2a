"""Text functions of the domain as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattix.functions import kernels


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_answer(text: pd.Series) -> pd.Series:
    """The names in the first bracketed list of a text, null without one: brackets nest, so SQL can't find them."""
    return text.map(lambda t: kernels.parse_answer(t if isinstance(t, str) else None))


def uri_id(uri: Column) -> Column:
    """The node id of an ontology uri, by its last segment; null for other uris."""
    last = F.element_at(F.split(uri, "/"), -1)
    out = F.lit(None).cast("string")
    # Prefixes of local names and of ids.
    for prefix, short in (("operation_", "op:"), ("topic_", "topic:"), ("data_", "data:"), ("format_", "fmt:")):
        out = F.when(last.startswith(prefix), F.concat(F.lit(short), last)).otherwise(out)
    return out


def sanitised(text: Column) -> Column:
    """A field for a tab-separated file: blanks for tabs and line ends, empty for null and the word None."""
    return F.when(text.isNull() | (text == "None"), "").otherwise(F.regexp_replace(text, "[\t\n\r]", " "))
