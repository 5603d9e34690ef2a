import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()} and all(r["round_trip"] for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "minhash_neardup", "mixing", "sentencepiece"]


CLASHES = ["c0", "c2", "doc", "key", "l", "n", "k", "o_text", "shard", "position", "run", "__q", "__kept", "__l", "__key", "__id"]


@pytest.fixture
def results(spark, odd_documents, no_documents, tmp_path):
    """What each stage makes of the odd rows, with more columns than any stage names itself, and of no rows."""
    spark.createDataFrame([(1, 0, 0), (2, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = odd_documents.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit("clash").alias(c) for c in CLASHES))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, rows.limit(0), str(tmp_path)).collect() == []
        df = stage(spark, rows, str(tmp_path))
        assert name == "sentencepiece" or df.columns == rows.columns
        out[name] = df.collect()
        assert name == "sentencepiece" or all(r[c] == "clash" for r in out[name] for c in CLASHES)
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows if r["doc_id"] is not None), sum(r["doc_id"] is None for r in rows)


def test_stages_on_odd_rows(results):
    assert ids(results["quality_rules"]) == ([1, 2, 2, 3], 1)  # the others are short or say everything twice
    assert ids(results["language_id"])[0] == [1, 2, 2, 3, 7, 8, 9] and ids(results["language_id"])[1] == 1  # no letters: 4, 5, 6, 10
    assert ids(results["minhash_neardup"]) == ([1, 4, 5, 6, 7, 8, 9, 10], 1)
    mixed = results["mixing"]
    drawn = {i: sum(r["doc_id"] == i for r in mixed) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)}
    assert drawn[4] == drawn[5] == drawn[6] == 0 and drawn[7] >= 0 and max(drawn.values()) <= 2 * 3
    pieces = {r["doc_id"]: r for r in results["sentencepiece"]}
    assert len(results["sentencepiece"]) == 12 and pieces[4]["n_tokens"] == pieces[5]["n_tokens"] == 0 and pieces[7]["round_trip"] and pieces[8]["round_trip"]
