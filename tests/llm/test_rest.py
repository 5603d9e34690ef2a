import base64
import inspect
import math
import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from lattix.llm import ann, common, langid, lm, pieces, quality, tokens
from lattix.llm.queries import TOKENIZERS

VOCABULARY, MODEL = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", f"{TOKENIZERS}/piece_bpe_32k.model"

# ---- token counts


def test_context_table(spark, odd_documents, no_documents):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lens = sorted(len(enc.encode_ordinary(r["text"] or "")) for r in odd_documents.collect())
    context = tokens.context_table(tokens.length_histogram(odd_documents, VOCABULARY)).cache()
    for r in context.collect():
        n = r["length"]
        assert r["n_docs"] == lens.count(n) and r["docs_from"] == sum(x >= n for x in lens) and r["tokens_from"] == sum(x for x in lens if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lens) and abs(r["share_upto"] - sum(x <= n for x in lens) / len(lens)) < 1e-12
    limits = [0, 1, 7, 50, 10**7]
    got = {r["limit"]: r for r in tokens.at_limits(context, limits).collect()}
    for c in limits:
        assert got[c]["truncated_tokens"] == sum(min(x, c) for x in lens) and got[c]["n_docs_cut"] == sum(x > c for x in lens)
    q = {r["share"]: r["length"] for r in tokens.quantiles(context, [0.1, 0.5, 1.0]).collect()}
    assert q == {s: lens[math.ceil(s * len(lens)) - 1] for s in (0.1, 0.5, 1.0)}
    assert tokens.context_table(tokens.length_histogram(no_documents, VOCABULARY)).collect() == []


# ---- language id

ALPHABETS = {"aa": "abcdefg ", "bb": "ghijklm ", "cc": "mnopqrs ", "dd": "stuvwxyz ", "ee": "abmnxyz ", "ff": "cdkluv "}


def spoken(n, seed):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(ALPHABETS[lang]) for _ in range(200)), lang) for i, lang in ((i, list(ALPHABETS)[i % 6]) for i in range(n))]


@pytest.mark.parametrize("languages", [2, 4, 6])
def test_held_out_accuracy(spark, languages):
    some = list(ALPHABETS)[:languages]
    rows = [r for r in spoken(300, 1) if r[2] in some]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, score string")
    model = langid.learn(df.where("doc_id % 4 <> 2"))
    out = df.where("doc_id % 4 = 2").select("lang", langid.predict_column(spark, model)("text").alias("p")).collect()
    assert out and sum(r["p"]["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["p"]["score"] <= 1 for r in out)


def test_codewords_differ():
    for n in range(2, 40):
        c = langid.codewords(n)
        assert len({tuple(r) for r in c}) == n
        assert n < 6 or min((c.shape[1] - c[i] @ c[j]) / 2 for i in range(n) for j in range(i)) >= 4


def test_language_of_odd_rows(spark, odd_documents, no_documents):
    for train in (odd_documents, no_documents, odd_documents.where("lang = 'en'")):
        model = langid.learn(train)
        out = {r["doc_id"]: r["p"] for r in odd_documents.select("doc_id", langid.predict_column(spark, model)("text").alias("p")).collect()}
        assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (4, 5, 6, 10)) and all(0 <= p["score"] <= 1 for p in out.values())
        assert train is no_documents or out[7]["lang_pred"] == "en"
    assert no_documents.select(langid.predict_column(spark, model)("text")).collect() == []


def test_many_languages_and_ambiguity(spark):
    """600 languages, each with words of its own; a text of two languages alike is flagged."""
    rng = random.Random(3)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(600)}
    said = lambda lang, n=40: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(2 * k + j, said(lang), lang) for k, lang in enumerate(words) for j in range(2)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == sorted(words)
    names, _ = model.predict([said(lang) for lang in words])
    assert np.mean([a == b for a, b in zip(names, words, strict=True)]) >= 0.95
    two = langid.learn(spark.createDataFrame([(1, "aaa bbb", "x"), (2, "ccc ddd", "y")], "doc_id bigint, text string, lang string"))
    df = spark.createDataFrame([(1, "aaa bbb"), (2, "aaa ccc bbb ddd"), (3, "12")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["p"] for r in df.select("doc_id", langid.predict_column(spark, two)("text").alias("p")).collect()}
    assert [got[i]["ambiguous"] for i in (1, 2, 3)] == [False, True, False] and got[1]["lang_pred"] == "x"


def test_language_learning_starts_no_second_kind_of_worker(spark):
    """Rows of the driver go to Spark as a table, not through Python workers on the executors."""
    df = spark.createDataFrame([(1, "aaa bbb", "x"), (2, "ccc ddd", "y")], "doc_id bigint, text string, lang string").localCheckpoint()
    below = langid.training_sample(df.where("doc_id > 0"), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in below and below.count("LogicalRDD") == 1  # df's own
    some = common.local_table(spark, {"lang": ["x", "y"], "up": [[True, False], None]}, "lang string, up array<boolean>")
    assert [tuple(r) for r in some.collect()] == [("x", [True, False]), ("y", None)]
    assert common.local_table(spark, {"lang": []}, "lang string").collect() == []


def test_words_go_through_in_bounded_lots(monkeypatch):
    texts = [" ".join("".join(random.Random(i).choices("abcdefgh", k=7)) for i in range(12_000)), "a b", None]
    weights = np.stack([np.random.default_rng(1).random(langid.BUCKETS), np.ones(langid.BUCKETS)], 1).astype(np.float32)
    model = langid.Model(["x", "y"], langid.codewords(2), weights, np.zeros(1), np.ones(1), np.ones(1))
    sizes, grams = [], langid.word_grams
    monkeypatch.setattr(langid, "word_grams", lambda words: sizes.append(len(words)) or grams(words))
    out, n = model.margins(texts)
    counted = next(iter(langid._count(iter([pd.DataFrame({"lang": ["x"], "text": texts[:1]})]))))
    assert max(sizes) <= 4_000 and counted["n"].sum() == n[0]
    monkeypatch.setattr(langid, "LOT_WORDS", 1 << 30)
    assert np.allclose(model.margins(texts)[0], out, rtol=1e-6)
    assert next(iter(langid._count(iter([pd.DataFrame({"lang": ["x"], "text": texts[:1]})])))).equals(counted)


def test_decoding_against_brute_force(spark):
    """Counts, classifiers, margins and losses again, one n-gram, bit and language at a time."""
    rows = spoken(24, 5)
    rows = [r for r in rows if r[2] in ("aa", "bb", "cc")] + [(None, "nothing to learn", "zz")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    grams = lambda t: [int(h) for w in langid.words_of(t) for h in langid.word_grams([w])[0]]
    counts = {x: Counter() for x in ("aa", "bb", "cc")}
    for i, t, lang in rows:
        if i is not None:
            counts[lang].update(grams(t))
    langs = sorted(counts)
    share = lambda x, h: (counts[x][h] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS)
    code = langid.codewords(3)
    mean = {}
    weight = lambda h, b: math.log(np.mean([share(x, h) for k, x in enumerate(langs) if code[k, b] > 0])) - math.log(np.mean([share(x, h) for k, x in enumerate(langs) if code[k, b] < 0]))
    table = {(h, b): weight(h, b) for h in set().union(*counts.values()) for b in range(code.shape[1])}
    zero = [weight(next(h for h in range(langid.BUCKETS) if not any(c[h] for c in counts.values())), b) for b in range(code.shape[1])]
    for x in langs:
        seen = sum(share(x, h) for h in {h for h, _ in table})
        mean[x] = [sum(share(x, h) * w for (h, c), w in table.items() if c == b) + (1 - seen) * zero[b] for b in range(code.shape[1])]
    bits = range(code.shape[1])
    low = [min(mean[x][b] for k, x in enumerate(langs) if code[k, b] > 0) for b in bits]
    high = [max(mean[x][b] for k, x in enumerate(langs) if code[k, b] < 0) for b in bits]
    gap = [max(a - z, 1e-3) for a, z in zip(low, high, strict=True)]
    for text in ("abc fed", "ghi jkl", "mno prs", "abc ghi mno", "adgjmp"):
        g = grams(text)
        loss = []
        for k in range(3):
            z = [(sum(table.get((h, b), zero[b]) for h in g) / len(g) - (low[b] + high[b]) / 2) / max(abs(low[b] - high[b]) / 4, 1e-3) for b in bits]
            loss.append(sum(math.log1p(math.exp(-2 * z[b] * code[k, b])) * gap[b] / sum(gap) * len(bits) for b in bits))
        p = sorted((math.exp(-x) for x in loss), reverse=True)
        names, scores = model.predict([text])
        assert names[0] == langs[int(np.argmin(loss))] and abs(scores[0] - (p[0] - p[1]) / sum(p)) < 1e-4


# ---- language-model scores


@pytest.mark.parametrize("top_words", [3, 1 << 19])
def test_lm_scores(spark, odd_documents, no_documents, top_words):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randrange(60)))) for i in range(200)] + [(300, None), (301, ""), (301, ""), (None, "w1 w2")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id bigint, text string, key string, row string")
    got = lm.score_documents(df, F.col("doc_id") % 10 != 0, top_words=top_words).collect()
    texts = [(i, (t or "").lower().split() + ["<end>"]) for i, t in rows]
    train = [t for i, t in texts if i is not None and i % 10]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<end>", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in texts)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    p = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    exact = {i: sum(math.log10((pairs[a, b] + lm.MU * p(b)) / (c[a] + lm.MU)) for a, b in zip(["<end>", *t], t, strict=False)) / len(t) for i, t in texts if i is not None}
    read = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got if r["doc_id"] is not None}
    assert np.corrcoef([exact[i] for i in exact], [read[i] for i in exact])[0, 1] > 0.97
    assert len(lm.score_documents(odd_documents, F.col("doc_id") > 2).collect()) == 12
    assert len(lm.score_documents(odd_documents, F.lit(False)).collect()) == 12
    assert lm.score_documents(no_documents, F.lit(True)).collect() == []


def test_filter_reads_back_levels():
    rng = np.random.default_rng(0)
    keys, q = rng.integers(1, 2**63, 3000).astype(np.uint64), rng.integers(1, 12, 3000)
    segments = 4
    of = lm._segment(keys, segments).astype(int)
    filter_ = np.frombuffer(b"".join(lm.segment_bits(keys[of == s], q[of == s]) for s in range(segments)), np.uint8)
    read = lm.read_levels(filter_, keys)
    assert (read >= q).all() and (read > q).mean() < 0.05
    assert (lm.read_levels(filter_, rng.integers(1, 2**63, 3000).astype(np.uint64)) > 0).mean() < 0.05


def test_lm_cells_leave_in_few_batches():
    """Cells of a chunk and a part, whose number grows with the square of the corpus, share batches and reads."""
    rng, parts = np.random.default_rng(1), 1_500
    lens = [600] * 20
    words = np.unique(rng.integers(1, 2**63, 5_000).astype(np.uint64))
    at = rng.integers(0, len(words), sum(lens)).astype(np.uint16)
    row = [pa.array([[False] * 20]), pa.array([lens], pa.list_(pa.int32())), pa.array([words.tobytes()]), pa.array([at.tobytes()])]
    counted = list(lm._counted(parts)(iter([pa.RecordBatch.from_arrays(row, ["held_out", "lens", "words", "at"])])))
    asked = list(lm._asked(parts)(iter([pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), *row[1:]], ["chunk", "lens", "words", "at"])])))
    assert sum(b.num_rows for b in counted) > parts and len(counted) == 2 and sum(b.num_rows for b in asked) > 1_400 and len(asked) == 1
    flat = words[at]
    for pair, every in ((False, flat), (True, lm.pairs(flat))):
        got = Counter({k: n for b in counted for r in b.to_pylist() if r["pair"] == pair for k, n in zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["n"], np.uint32).tolist(), strict=True)})
        assert got == Counter(every.tolist())
    # the cells of two parts, asked by three chunks each
    keys = [rng.integers(1, 2**63, 40).astype(np.uint64) for _ in range(6)]
    filters = [np.frombuffer(lm.filter_of(np.concatenate(keys[:2]), rng.integers(1, 90, 80)), np.uint8), np.frombuffer(lm.filter_of(keys[3], np.full(40, 9)), np.uint8)]
    rows = [(p, c, filters[p].tobytes() if c is None else keys[3 * p + c].tobytes()) for p in (0, 1) for c in (None, 0, 1, 2)]
    rows.append((2, 0, keys[0].tobytes()))  # a part without a filter
    table = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])], ["part", "chunk", "data"])
    for lot in (1, 3, 9):
        answers = list(lm._answered(iter([table.slice(i, lot) for i in range(0, 9, lot)])))
        got = {(r["part"], r["chunk"]): r["levels"] for b in answers for r in b.to_pylist()}
        want = {(p, c): lm.read_levels(filters[p], keys[3 * p + c]).astype(np.uint8).tobytes() for p in (0, 1) for c in range(3)} | {(2, 0): bytes(40)}
        assert got == want and len(answers) == 3


def test_lm_task_memory_is_bounded():
    """Counting four chunks takes a task's worker some tens of megabytes for each million tokens held, not for all of them."""
    rng = np.random.default_rng(2)

    def chunks():
        for _ in range(4):
            words = np.unique(rng.integers(1, 2**63, 100_000).astype(np.uint64))
            at = rng.integers(0, len(words), 1_000_000).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([[False]]), pa.array([[1_000_000]], pa.list_(pa.int32())), pa.array([words.tobytes()]), pa.array([at.tobytes()])], ["held_out", "lens", "words", "at"])

    tracemalloc.start()
    try:
        n = sum(len(k) for b in lm._counted(64)(chunks()) for k in b["n"].to_pylist()) // 4
        assert n > 3_000_000 and tracemalloc.get_traced_memory()[1] < 180e6
    finally:
        tracemalloc.stop()


def test_large_rows_are_stored_in_small_groups(spark, tmp_path):
    rows = spark.range(0, 12, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(i).bytes(3 << 20)])], ["x"]) for b in batches for i in b.column(0).to_pylist()), "x binary")
    out = common.stored(rows, "large", large_rows=True)
    files = [pq.ParquetFile(f).metadata for f in Path(out._stored_at.removeprefix("file:")).glob("*.parquet")]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 12 and max(g.total_byte_size for g in groups) < 16 << 20
    assert sorted(r["n"] for r in out.selectExpr("length(x) as n").collect()) == [3 << 20] * 12
    common.remove(out)


def test_no_ngram_is_dropped(spark, monkeypatch):
    """Scores follow from the quantised counts of all n-grams, however many there are."""
    monkeypatch.setattr(lm, "MAX_BITS", 1 << 16, raising=False)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 500, raising=False)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(60))) for i in range(300)]
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") % 10 != 0).collect()
    texts = {i: [*t.split(), "<end>"] for i, t in rows}
    c, pairs = Counter(), Counter()
    for i, t in texts.items():
        if i % 10:
            c.update(t)
            pairs.update(zip(["<end>", *t], t, strict=False))
    n, v = sum(c.values()), len(c)
    near = lambda k: float(lm.count_of_level(np.array([math.floor(math.log(k, lm.BASE) + 1e-9) + 1 if k else 0]))[0])
    p = lambda w: (near(c[w]) + lm.ADD) / (n + lm.ADD * (v + 1))
    want = {i: sum(math.log10(min(1, (min(near(pairs[a, b]), near(c[a])) + lm.MU * p(b)) / (near(c[a]) + lm.MU))) for a, b in zip(["<end>", *t], t, strict=False)) for i, t in texts.items()}
    away = [abs(r["score"] - want[r["doc_id"]]) / r["n_tokens"] for r in got]
    assert len(away) == 300 and np.median(away) < 0.01 and max(away) < 0.2


# ---- nearest neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    rows = [(i, [float(e) for e in v], "clash") for i, v in enumerate(x)]
    rows += [(2000, None, ""), (2020, [0.0] * 16, ""), (2040, [float("nan")] * 16, ""), (2060, [None] * 16, ""), (2080, [], ""), (None, [1.0] * 16, ""), (2100, [1.0, 2.0], ""), (20, rows[20][1], "again")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, block_rows=100, query_rows=16).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1500, 20))
    hits = 0
    xd = x.astype(np.float64)
    for i, rs in by.items():
        s = xd @ xd[i]
        s[i] = -np.inf
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in rs)
        assert rs == sorted(rs, key=lambda r: (-r["score"], r["vec_id"]))
        hits += len({r["vec_id"] for r in rs} & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(by)


@pytest.mark.parametrize("norms", ["equal", "unequal"])
def test_nearest_of_clustered_vectors(spark, norms):
    """The stopping test allows a miss of 3 % at most, and clustered vectors keep their recall.  Where norms are equal, most
    rows are never looked at."""
    assert inspect.signature(ann.nearest).parameters["confidence"].default >= 0.97
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((30, 32))[rng.integers(0, 30, 3000)] + 0.15 * rng.standard_normal((3000, 32))).astype(np.float32)
    if norms == "equal":
        x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    by = {}
    verified = spark.sparkContext.accumulator(0)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, block_rows=256, verified=verified).collect():
        by.setdefault(r["query_id"], set()).add(r["vec_id"])
    print("share of rows verified", verified.value / (150 * 3000))
    assert norms == "unequal" or verified.value < 0.5 * 150 * 3000
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -np.inf)
    recall = np.mean([len(by[i] & set(np.argsort(-s[i])[:20].tolist())) / 20 for i in by])
    print("recall on clustered vectors", recall)
    assert len(by) == 150 and recall >= 0.97


def test_nearest_with_few_and_equal_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in (0, 3, 2, 1)], "vec_id bigint, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 5.0), (0, 2, 2, 5.0), (0, 3, 3, 5.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).collect() == []


def test_a_crowd_in_one_place(spark):
    """A third of all rows are one vector: its cell has several chunks, and ties go to the smaller ids."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1200, 8))
    x[::3] = 3.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    by = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, block_rows=64, query_rows=8).collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hot = list(range(0, 1200, 3))
    for q, found in by.items():
        if q % 3 == 0:
            assert [v for _, v in sorted(found)] == [v for v in hot if v != q][:20]


def test_cells_cover_all_rows():
    y = np.random.default_rng(2).standard_normal((5000, 8))
    cells = ann.cells_of(y, ann.fit_cells(y, 5))
    assert set(cells.tolist()) == set(range(32)) and np.bincount(cells).max() < 2 * 5000 / 32
    assert (ann.cells_of(np.ones((9, 8)), ann.fit_cells(np.ones((9, 8)), 3)) == 0).all()


def test_chi_square_quantile():
    for p, k, want in ((0.9, 8, 13.3616), (0.95, 1, 3.8415), (0.5, 10, 9.3418)):
        assert abs(ann.chi_square_quantile(p, k) - want) < 1e-3


# ---- sentence pieces


def test_pieces_equal_the_library(spark, odd_documents, no_documents):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    p = pieces.Pieces.load(MODEL)
    rng = random.Random(6)
    texts = ["", " ", "  a  b ", "don't https://x.y/z?q=1", "a" * 300, "日本語、中文\U0001f600", "\t\n x\u0301", "def f(x):\n    return x"]
    texts += ["".join(rng.choice(p.texts[300:]) for _ in range(12)).replace(pieces.BLANK, " ") for _ in range(300)]
    ours = p.encode(texts)
    assert [o.tolist() for o in ours] == [list(x) for x in sp.encode(texts)]
    assert [p.decode(o) for o in ours] == texts
    out = {r["doc_id"]: r for r in pieces.encode_documents(odd_documents, MODEL, keep=["doc_id", "rank"]).collect()}
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.values()) and out[4]["ids"] == [] and out[1]["round_trip"] and out[1]["rank"] == "clash"
    assert not out[9]["round_trip"]  # the format has no way to tell U+2581 from a blank
    assert pieces.encode_documents(no_documents, MODEL, keep=["doc_id"]).collect() == []


def test_one_long_text_without_blanks():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    assert pieces.Pieces.load(MODEL).encode([text])[0].tolist() == sp.encode(text)


def message(*fields):
    """A message in the wire format, of short (number, integer or bytes) fields."""
    return b"".join(bytes([n << 3, v]) if isinstance(v, int) else bytes([n << 3 | 2, len(v)]) + v for n, v in fields)


@pytest.mark.parametrize(
    ("trainer", "normaliser", "what"),
    [([(3, 3)], [(4, 0)], "neither unigram"), ([(3, 2)], [(2, b"x"), (4, 0)], "normalisation"), ([(3, 2)], [(4, 1)], "extra blanks"), ([(3, 1)], [(3, 0), (4, 0)], "dummy prefix"), ([], [], "extra blanks")],
)
def test_settings_that_are_not_followed_are_refused(tmp_path, trainer, normaliser, what):
    piece = message((1, b"a"), (3, 1))
    (tmp_path / "m").write_bytes(message((1, piece), (2, message(*trainer)), (3, message(*normaliser))))
    with pytest.raises(ValueError, match=what):
        pieces.Pieces.load(str(tmp_path / "m"))
    (tmp_path / "m").write_bytes(message((1, piece), (2, message((3, 1))), (3, message((4, 0)))))
    assert not pieces.Pieces.load(str(tmp_path / "m")).merges


def test_a_text_of_ten_megabytes(spark):
    """One very long text goes whole through every operator that sends texts to Python."""
    text = " ".join(f"w{i % 50_021}" for i in range(1_500_000)) + " " + "x" * 100
    df = spark.createDataFrame([(1, text, "en"), (3, "short one", "en")], "doc_id bigint, text string, lang string")
    assert quality.judge(df, [], keep=["doc_id"]).where("doc_id = 1").select("__q.n_words", "__q.n_repeat_words").first() == (1_500_001, 1_500_000)
    assert df.select(langid.predict_column(spark, langid.learn(df))("text").alias("p")).where("p.lang_pred = 'en'").count() == 2
    assert tokens.encoded_lengths(df, VOCABULARY).agg(F.max("length")).first()[0] > 3_000_000
    assert {r["doc_id"]: r["n_tokens"] for r in lm.score_documents(df, F.lit(True)).collect()} == {1: 1_500_002, 3: 3}
    assert pieces.encode_documents(df, MODEL, keep=["doc_id"]).where("doc_id = 1 and round_trip").count() == 1


def test_unigram_viterbi_is_the_best_path():
    texts = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca"]
    scores = np.array([0, -2.5, -2.1, -2.2, -2.3, -3.0, -3.9, -5.5, -3.6, -5.0, -3.3])
    p = pieces.Pieces(texts, scores, np.array([pieces.UNKNOWN] + [pieces.NORMAL] * 10), False)

    def best(word):
        top = {0: (0.0, [])}
        for i in range(1, len(word) + 1):
            top[i] = max((top[j][0] + scores[p.ids[word[j:i]]], top[j][1] + [p.ids[word[j:i]]]) for j in range(i) if word[j:i] in p.ids and j in top)
        return top[len(word)]

    rng = random.Random(7)
    for _ in range(200):
        word = pieces.BLANK + "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        got = p.viterbi([word])[0].tolist()
        assert abs(sum(scores[i] for i in got) - best(word)[0]) < 1e-9 and "".join(texts[i] for i in got) == word
    assert p.viterbi([pieces.BLANK + "az"])[0].tolist()[-1] == 0
