"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return
the columns of documents.  What a stage learns, it learns from its own input and the labels.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattix.llm import langid, mixing, neardup, pieces, quality
from lattix.llm.common import bounded_batches, shared_dir, stored, table
from lattix.llm.queries import TOKENIZERS


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns c0, c1, ..., and these names by the former ones: no column of theirs can clash with a stage's own."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*names.values()).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects.  A null text has no words and goes."""
    bounded_batches(spark)
    rules = quality.learn_rules(docs, table(spark, sf_dir, "labels"))
    rows, names = _numbered(docs)
    return _named(quality.judge(rows, rules, text=names["text"]).where("__kept"), docs, names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those that have none, or whose language is ambiguous, go.
    Where no document has a language to learn from, all stay."""
    bounded_batches(spark)
    model = langid.learn(docs)
    if not model.languages:
        return docs
    rows, names = _numbered(docs)
    known = rows.withColumn("l", langid.predict_column(spark, model)(names["text"]))
    return _named(known.where((F.col("l.lang_pred") != langid.UNKNOWN) & ~F.col("l.ambiguous")), docs, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id; of rows with one id, the one with the least text, then the
    least language and source; rows without an id stay.  Only rows whose id comes again are sorted by their texts."""
    found = stored(neardup.near_duplicates(docs).select("doc_id", "kept"), "near")
    dropped = stored(found.where("not kept").select("doc_id").distinct(), "dropped")  # fewer than those that stay
    again = stored(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    rows, names = _numbered(docs)
    own = F.col(names["doc_id"]).cast("long")
    rows = rows.join(dropped, own == dropped["doc_id"], "left_anti")
    if not again.isEmpty():
        order = [names[c] for c in ("text", "lang", "source") if c in names]
        first = F.row_number().over(Window.partitionBy(names["doc_id"]).orderBy(*order))
        one = rows.join(again, own == again["doc_id"], "left_semi").withColumn("k", first).where("k = 1").drop("k")
        rows = rows.join(again, own == again["doc_id"], "left_anti").unionByName(one)
    return _named(rows, docs, names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix draws it, in the shards' order.  A document at the end of its source's quota
    is drawn whole if at least half of it was.  A document without an id goes by a hash of its text, and rows that
    share an id share its draws."""
    rows, names = _numbered(docs)
    text = F.col(names["text"])
    keyed = rows.withColumn("key", F.coalesce(F.col(names["doc_id"]).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))))
    draws = mixing.mix(keyed.select(F.col("key").alias("doc_id"), F.col(names["source"]).alias("source"), text.alias("text"))).select(F.col("doc_id").alias("key"), "size", F.explode("draws").alias("d"))
    draws = draws.select("key", "size", "d.pass", "d.shard", "d.words", "d.position").where(F.col("words") * 2 >= F.col("size")).dropDuplicates(["key", "pass"])
    out = keyed.join(draws.select("key", "shard", "position"), "key")
    # a shard's rows in order of their hashes, cut into runs so that no task holds a whole shard
    out = out.withColumn("run", F.shiftrightunsigned("position", 60)).repartition("shard", "run").sortWithinPartitions("shard", "position")
    return _named(out, docs, names)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, language, source and the encoded text of every document of the mix."""
    bounded_batches(spark)
    return pieces.encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model", keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("minhash_neardup", near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", sentence_pieces),
]

#: SQL can't express the learned rules, the classifiers and the encoder.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{base}-{k}-{name}.parquet"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
