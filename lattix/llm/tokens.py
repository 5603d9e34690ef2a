"""Token counts as an exact histogram of encoded lengths.

Every whole text is encoded once; only its length leaves the task, where lengths are counted before the shuffle.
The histogram has one row per distinct length, and sums over it from a length upwards answer, for every context limit
at once, how many documents and tokens there are, where a quantile lies, and how many tokens are left when texts are
cut at the limit: tokens below the limit plus the limit times the documents that reach it.

The vocabulary file is read on the driver and broadcast; its size is that of the file, checked against ``MAX_BYTES``.

Defined results: a null or empty text has length 0; repeated rows count repeatedly; further columns are ignored; an
empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BYTES = 64 << 20
#: Fixed value: the splitting pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, tiktoken.Encoding] = {}


def _encoder(shared, pattern: str) -> tiktoken.Encoding:
    key = hash((shared.value, pattern))
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in shared.value.splitlines() if x)}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encoded_lengths(docs: DataFrame, vocabulary: str, *, pattern: str = PATTERN) -> DataFrame:
    """One row (length) per document."""
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"{vocabulary} has more than {MAX_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared, pattern).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x)) if (x := t.as_py()) else 0 for t in b.column(0)], pa.int64())], ["length"])

    return docs.select("text").mapInArrow(run, "length long")


def length_histogram(docs: DataFrame, vocabulary: str, *, pattern: str = PATTERN) -> DataFrame:
    """(length, n_docs), one row per distinct length."""
    return encoded_lengths(docs, vocabulary, pattern=pattern).groupBy("length").agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For every distinct length, taken as a context limit: what lies at it, from it upwards and below it.
    ``share_upto`` is the part of the documents that fit, so the q-quantile is the first length where it reaches q.
    The windows run over distinct lengths, of which there are no more than the longest text has tokens."""
    up = Window.orderBy(F.desc("length"))
    every = Window.partitionBy()
    x = histogram.withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    x = x.withColumn("docs_from", F.sum("n_docs").over(up)).withColumn("tokens_from", F.sum("n_tokens").over(up))
    x = x.withColumn("docs", F.sum("n_docs").over(every)).withColumn("tokens", F.sum("n_tokens").over(every))
    return x.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_from",
        "tokens_from",
        (F.col("tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_tokens"),
        ((F.col("docs") - F.col("docs_from") + F.col("n_docs")) / F.col("docs")).alias("share_upto"),
    )


def at_limits(context: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, n_docs_cut, truncated_tokens) for any limits: the figures of the first length at or above each."""
    total = context.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"))
    want = context.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    # the limits are few and broadcast; the table of lengths is not
    at = context.join(F.broadcast(want), F.col("length") >= F.col("limit")).groupBy("limit").agg(F.min_by(F.struct("length", "n_docs", "docs_from", "tokens_from"), "length").alias("c"))
    x = want.distinct().join(at, "limit", "left")
    over = F.coalesce(F.col("c.docs_from") - F.when(F.col("c.length") == F.col("limit"), F.col("c.n_docs")).otherwise(0), F.lit(0))
    return x.crossJoin(total).select(
        "limit", over.alias("n_docs_cut"), (F.col("tokens") - F.coalesce(F.col("c.tokens_from"), F.lit(0)) + F.col("limit") * F.coalesce(F.col("c.docs_from"), F.lit(0))).alias("truncated_tokens")
    )


def quantiles(context: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents doesn't exceed."""
    want = context.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return context.join(F.broadcast(want), F.col("share_upto") >= F.col("share")).groupBy("share").agg(F.min("length").alias("length"))
