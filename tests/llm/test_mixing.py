from collections import defaultdict

from pyspark.sql import functions as F

from lattix.llm import mixing


def water_level(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    total = sum(sizes.values())
    while True:
        left, open_ = total - sum(most * sizes[s] for s in full), [s for s in names if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def documents(spark, n=400):
    rows = [(i, ["a", "b", "c", "dé", None][0 if i % 3 == 0 else i % 5], " ".join(["w"] * (i % 23)) if i % 31 else None) for i in range(n)]
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id bigint, source string, text string, size string, rank int")


def test_targets_and_draws(spark):
    docs = documents(spark)
    got = mixing.mix(docs, shard_words=200).collect()
    assert len(got) == 400
    sizes = defaultdict(int)
    taken, target = defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(d["words"] for d in r["draws"])
        assert len({d["pass"] for d in r["draws"]}) == len(r["draws"])
    want = water_level(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 0.5
    again = {r["doc_id"]: r["draws"] for r in mixing.mix(docs.repartition(7), shard_words=200).collect()}
    assert again == {r["doc_id"]: r["draws"] for r in got}


def test_more_shards_and_blocks_than_4096(spark):
    docs = documents(spark, 60)
    got = mixing.mix(docs, shard_words=0.1).collect()
    words = sum(r["taken"] for r in got)
    shards = defaultdict(int)
    for r in got:
        assert r["taken"] <= 3 * r["size"]
        for d in r["draws"]:
            shards[d["shard"]] += d["words"]
    assert max(shards) > 4096 and sum(shards.values()) == words and mixing.block_digits(words, 0.1) == 4


def test_shards_have_equal_numbers_of_blocks(spark):
    units = spark.createDataFrame([(1, 37), (2, 501), (3, 0), (4, 90)], "rank int, units long")
    out = mixing.split_tree(units, 3).groupBy("shard").agg(F.sum("units").alias("n")).collect()
    assert len(out) == 8 and {r["n"] for r in out} <= {78, 79} and sum(r["n"] for r in out) == 628


def test_hypergeometric_is_the_quantile(spark):
    from math import comb

    cases = [(20, 7, 9, u / 40 + 0.01) for u in range(39)] + [(5, 0, 3, 0.5), (5, 5, 3, 0.5), (4, 2, 0, 0.9), (400, 100, 200, 0.5)]
    df = spark.createDataFrame(cases, "n long, k long, d long, u double").select("*", mixing.hypergeometric(F.col("n"), F.col("k"), F.col("d"), F.col("u")).alias("x"))
    for r in df.collect():
        p, x = 0.0, max(0, r["d"] - (r["n"] - r["k"]))
        while True:
            p += comb(r["k"], x) * comb(r["n"] - r["k"], r["d"] - x) / comb(r["n"], r["d"])
            if p >= r["u"] - 1e-9:
                break
            x += 1
        assert r["x"] == x


def test_odd_rows(odd_documents, no_documents):
    got = mixing.mix(odd_documents).collect()
    assert len(got) == 12 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (4, 5, 6)} == {0}
    assert mixing.mix(no_documents).collect() == []
    assert all(r["target"] == 0 and r["taken"] == 0 for r in mixing.mix(odd_documents.where("doc_id in (4, 5, 6)")).collect())


def test_native(spark):
    plan = mixing.mix(documents(spark, 20))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
