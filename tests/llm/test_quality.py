import random

from lattix.llm import quality


def plain(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def test_statistics():
    rng = random.Random(1)
    texts = [None, "", " \n", "a", "a a a a", "a b c a b c", "x y\nx y\n\nx  y\nx y"] + [" ".join(rng.choice("abcd é# |") for _ in range(rng.randrange(80))) for _ in range(60)]
    for t in texts:
        assert quality.measure(t)[:5] == plain(t), repr(t)


def labelled(spark, n=600):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = [("#" if bad and rng.random() < 0.4 else "") + f"w{rng.randrange(5000)}" for _ in range(80)]
        docs.append((i, " ".join(w), "clash", "clash"))
        labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 0, 0), (5, None, 0), (10_000, 0, 0)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, s string, n_words string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_learns_and_explains(spark):
    docs, labels = labelled(spark)
    rules = quality.learn_rules(docs.where("doc_id < 300"), labels)
    assert rules and "symbols_per_word" in quality.describe(rules)[0]
    rows = quality.judge(docs.where("doc_id >= 300"), rules).select("doc_id", "__kept", "n_words").collect()
    assert all(r["__kept"] == (r["doc_id"] % 4 != 0) for r in rows) and {r["n_words"] for r in rows} == {"clash"}
    assert rules == quality.learn_rules(docs.where("doc_id < 300").repartition(5), labels.repartition(3))


def test_repeated_labels_and_documents_give_the_same_rules(spark):
    docs, labels = labelled(spark, 300)
    docs, labels = docs.unionByName(docs).unionByName(docs), labels.unionByName(labels)
    rules = [quality.learn_rules(docs.repartition(n), labels.repartition(n + 1), max_rows=150) for n in (1, 5)]
    assert rules[0] and rules[0] == rules[1]


def test_conjunctions_and_order():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    rows = pd.DataFrame({c: rng.integers(50, 100, 3000) for c in quality.BASE + quality.MORE})
    x = quality.feature_arrays(rows)
    bad = (x["symbols_per_word"] > 1.2) & (x["marks_per_word"] <= 0.8)
    rules = quality.cover(rows, bad)
    assert max(map(len, rules)) >= 2
    got = np.zeros(3000, bool)
    for r in rules:
        got |= quality._matches(r, x, 3000)
    assert (got & bad).sum() >= 0.85 * bad.sum() and (got & ~bad).sum() <= 0.05 * bad.sum()


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rules = quality.learn_rules(odd_documents, some)
        rows = quality.judge(odd_documents, rules, keep=["doc_id"]).select("doc_id", "__base_failed", "__kept").collect()
        assert len(rows) == 12 and {r["doc_id"] for r in rows if not r["__base_failed"]} == {1, 2, 3, None}  # 7 says everything twice
    assert quality.judge(no_documents, []).collect() == []


def test_only_labelled_texts_are_measured_and_each_once(spark, tmp_path):
    docs, labels = labelled(spark)
    docs.write.parquet(f"{tmp_path}/docs")
    rows = quality.labelled_statistics(spark.read.parquet(f"{tmp_path}/docs"), labels.where("doc_id < 40"), 100)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Join")  # the join is below it
    assert sorted(r["__id"] for r in rows.collect()) == list(range(40))
