"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised logarithmically, q = 1 + floor(log_b(count)), and the filter holds the
pairs (n-gram, 1) ... (n-gram, q).  A count is read by probing (n-gram, 1), (n-gram, 2), ... until one is missing; an
overestimate needs a run of false positives and so gets exponentially unlikely.  Probabilities are smoothed:

    p(w)     = (c(w) + 0.1) / (N + 0.1 * (V + 1))
    p(w | v) = (c(v w) + MU * p(w)) / (c(v) + MU)

with the read counts, and a document's score is the sum of log10 p(w | v) over its tokens; before the first word
stands the end token.

The n-grams are dealt by hash to parts of about ``PART_TOKENS`` tokens, whose number grows with the corpus.  Each part has
its own filter, as large as its n-grams need (cut into segments of 65,536 bits), so no count is left out and no task or
broadcast holds the whole filter.  Texts are tokenised once into chunks of about a million tokens; a chunk sends its
distinct n-grams to the parts, gets their counts back and is scored with these.

Base scores are exact: counts of at most ``TOP_WORDS`` most frequent words are broadcast, tokens outside them
are joined with the whole table of counts.  Words and pairs are keyed by 64-bit hashes.

Defined results: a null text is empty, that is, only the end token; a row with a null id is held out; without
training rows N and V are 0 and every word is unknown; repeated rows are scored repeatedly; further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.llm.common import LOT_BYTES, batch_rows, release_memory, remove, stored
from lattix.llm.neardup import _hash_of, _hashes, mixed

SEGMENT_BITS, PROBES, BITS_PER_ENTRY = 1 << 16, 4, 12
CHUNK_TOKENS, PART_TOKENS, LEAST_PARTS = 1_000_000, 1_000_000, 64
TOP_WORDS = 1 << 19
BASE, MU, ADD = 1.5, 4.0, 0.1
END = xxhash.xxh3_64_intdigest(b" end")  # no word holds a blank
_LEVEL = np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 2_000_000
#: Rows of a batch at most where its bytes bound it.
_BATCH = 10_000


def tokens(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    out[-1] = END
    return out


def pairs(t: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it; ``t`` may hold several texts one after the other, as each ends in END."""
    before = np.empty_like(t)
    before[0], before[1:] = END, t[:-1]
    return mixed(before * np.uint64(0xC2B2AE3D27D4EB4F) + t) | np.uint64(1)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as chunks of some tokens: ids, held_out and lens of the texts, the distinct words and the tokens' places in them."""
    ids: list[int | None] = []
    out_of: list[bool] = []
    held: list[np.ndarray] = []
    size = 0

    def flush():
        lens = pa.array([[len(t) for t in held]], pa.list_(pa.int32()))
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
        columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([out_of], pa.list_(pa.bool_())), lens, pa.array([words.tobytes()]), pa.array([at.tobytes()])]
        for x in (ids, out_of, held):
            x.clear()
        return pa.RecordBatch.from_arrays(columns, ["ids", "held_out", "lens", "words", "at"])

    for b in batches:
        for i, o, t in zip(*b.columns, strict=True):
            ids.append(i.as_py())
            out_of.append(o.as_py())
            held.append(x := tokens(t.as_py()))
            size += len(x)
            if size >= CHUNK_TOKENS:
                yield flush()
                size = 0
    if held:
        yield flush()
    _hashes.clear()
    release_memory()


def _flat(words: pa.Scalar, at: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of a chunk and the places of its ``n`` tokens in them."""
    raw = at.as_py()
    return np.frombuffer(words.as_py(), np.uint64), np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys + np.uint64(0x165667B19E3779F9)) % np.uint64(parts)).astype(np.int64)


def _dealt(keys: np.ndarray, parts: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """An order of the keys by part, and (part, start, end) of each part that has keys."""
    of = _part(keys, parts)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(parts + 1))
    return order, ((p, int(edges[p]), int(edges[p + 1])) for p in np.flatnonzero(np.diff(edges)).tolist())


def _cells(spans: Iterator[tuple[int, int, int]], *values: np.ndarray) -> Iterator[list[pa.Array]]:
    """The spans' parts and what each of ``values`` has there, in lots of some megabytes: a batch for each cell, of which
    there are as many as chunks times parts, would take most of the time."""
    parts: list[int] = []
    cells: list[list[bytes]] = [[] for _ in values]
    size = 0
    for p, a, b in spans:
        parts.append(p)
        for held, x in zip(cells, values, strict=True):
            held.append(x[a:b].tobytes())
            size += len(held[-1])
        if size >= LOT_BYTES:
            yield [pa.array(parts, pa.int64()), *(pa.array(held, pa.binary()) for held in cells)]
            for held in (parts, *cells):
                held.clear()
            size = 0
    if parts:
        yield [pa.array(parts, pa.int64()), *(pa.array(held, pa.binary()) for held in cells)]


def _counted(parts: int):
    """Counts of the training texts' words and pairs by part, summed over some millions of tokens before they leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            flat = np.concatenate(held)
            held.clear()
            for pair, every in ((False, flat), (True, pairs(flat))):
                keys, n = np.unique(every, return_counts=True)
                order, spans = _dealt(keys, parts)
                keys, n = keys[order], n[order].astype(np.uint32)
                for of, k, c in _cells(spans, keys, n):
                    yield pa.RecordBatch.from_arrays([of, pa.array([pair] * len(of)), k, c], ["part", "pair", "keys", "n"])

        for batch in batches:
            for o, l, w, t in zip(*batch.columns, strict=True):  # noqa: E741
                lens = np.array(l.as_py())
                words, at = _flat(w, t, int(lens.sum()))
                x = words[at[np.repeat(~np.array(o.as_py(), bool), lens)]]
                if len(x):
                    held.append(x)
                    size += len(x)
                if size >= _FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()
        release_memory()

    return run


def _summed(keys: list[bytes], n: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    every, back = np.unique(np.frombuffer(b"".join(keys), np.uint64), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, back, np.frombuffer(b"".join(n), np.uint32).astype(np.int64))
    return every, total


def _modelled(rows: pa.Table) -> pa.Table:
    """A part's filter and the exact counts of its words."""
    got = {pair: _summed(*(rows.filter(pc.equal(rows["pair"], pair))[c].to_pylist() for c in ("keys", "n"))) for pair in (False, True)}
    (words, times), (two, times2) = got[False], got[True]
    bits = filter_of(np.concatenate([words, two]), np.concatenate([times, times2]))
    counts = pa.StructArray.from_arrays([pa.array(words.view(np.int64)), pa.array(times)], ["key", "n"])
    counts = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), counts)
    return pa.table({"part": rows["part"].slice(0, 1), "bits": pa.array([bits]), "words": counts})


def quantised(n: Column) -> Column:
    return (F.floor(F.log(n.cast("double")) / math.log(BASE) + 1e-9) + 1).cast("int")


def count_of_level(q: np.ndarray) -> np.ndarray:
    """The middle of the counts with this quantised value; 0 for 0."""
    return np.where(q > 0, (BASE ** (q - 1.0) + np.maximum(BASE ** q.astype(float) - 1, 1)) / 2, 0.0)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(keys) >> np.uint64(32)) % np.uint64(segments)


def _offsets(keys: np.ndarray, level: int) -> np.ndarray:
    """Bits of (key, level) inside the key's segment: one hash gives all probes."""
    h = mixed(keys ^ np.uint64(level * int(_LEVEL) & (2**64 - 1)))
    return np.stack([(h >> np.uint64(16 * k)) & np.uint64(SEGMENT_BITS - 1) for k in range(PROBES)])


def segment_bits(keys: np.ndarray, q: np.ndarray) -> bytes:
    bits = np.zeros(SEGMENT_BITS, bool)
    for level in range(1, int(q.max(initial=0)) + 1):
        bits[_offsets(keys[q >= level], level).astype(np.int64).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def read_levels(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The quantised count of each key, by repeated probes."""
    out = np.zeros(len(keys), np.int64)
    segments = len(filter_) * 8 // SEGMENT_BITS
    if not segments:
        return out
    at = np.arange(len(keys))
    start = (_segment(keys, segments) * np.uint64(SEGMENT_BITS)).astype(np.int64)
    level = 1
    while len(at):
        there = np.ones(len(at), bool)
        for o in _offsets(keys[at], level):
            i = start[at] + o.astype(np.int64)
            there &= (filter_[i >> 3] >> (i & 7).astype(np.uint8)) & 1 != 0
        at = at[there]
        out[at] = level
        level += 1
        if level > 80:
            break
    return out


def filter_of(keys: np.ndarray, n: np.ndarray) -> bytes:
    """The filter of all these counts, as large as they need."""
    q = np.floor(np.log(n) / math.log(BASE) + 1e-9).astype(np.int64) + 1
    segments = max(1, math.ceil(int(q.sum()) * BITS_PER_ENTRY / SEGMENT_BITS))
    of = _segment(keys, segments)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(segments + 1, dtype=np.uint64))
    return b"".join(segment_bits(keys[x], q[x]) for x in (order[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)))


def _asked(parts: int):
    """The distinct n-grams of each chunk by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, l, w, t in zip(*batch.columns, strict=True):  # noqa: E741
                words, at = _flat(w, t, sum(l.as_py()))
                keys = np.concatenate([words, np.unique(pairs(words[at]))])
                order, spans = _dealt(keys, parts)
                keys = keys[order]
                for of, data in _cells(spans, keys):
                    yield pa.RecordBatch.from_arrays([of, pa.array([chunk.as_py()] * len(of), pa.int64()), data], ["part", "chunk", "data"])
        release_memory()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quantised counts of the n-grams asked for; a part's filter comes as its first row, without a chunk."""
    part, filter_ = None, np.zeros(0, np.uint8)
    chunks: list[int] = []
    held: list[bytes] = []
    size = 0

    def flush():
        read = read_levels(filter_, np.frombuffer(b"".join(held), np.uint64)).astype(np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(x) // 8 for x in held])]).tolist()
        columns = [pa.array(chunks, pa.int64()), pa.array([part] * len(chunks), pa.int64()), pa.array([read[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())]
        chunks.clear()
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["chunk", "part", "levels"])

    for batch in batches:
        for p, chunk, data in zip(*batch.columns, strict=True):
            if held and (size >= LOT_BYTES // 4 or p.as_py() != part or not chunk.is_valid):
                yield flush()
                size = 0
            if p.as_py() != part:
                part, filter_ = p.as_py(), np.zeros(0, np.uint8)
            if not chunk.is_valid:
                filter_ = np.frombuffer(data.as_py(), np.uint8)
            else:
                chunks.append(chunk.as_py())
                held.append(data.as_py())
                size += len(held[-1])
    if held:
        yield flush()
    release_memory()


def _scored(shared, parts: int, n_train: int, n_distinct: int):
    below = n_train + ADD * (n_distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, counts = shared.value
        for batch in batches:
            for ids, held_out, l, w, t, levels in zip(*batch.columns, strict=True):  # noqa: E741
                lens = np.array(l.as_py())
                starts = np.cumsum(lens) - lens
                words, back = _flat(w, t, int(lens.sum()))
                flat = words[back]
                at = np.minimum(np.searchsorted(top, words), max(0, len(top) - 1))
                found = top[at] == words if len(top) else np.zeros(len(words), bool)
                exact = np.where(found, counts[at], 0) if len(top) else np.zeros(len(words))
                base = np.where(found, np.log10((exact + ADD) / below), 0.0)
                two, back2 = np.unique(pairs(flat), return_inverse=True)
                every = np.empty(len(words) + len(two))
                order, _ = _dealt(np.concatenate([words, two]), parts)
                every[order] = count_of_level(np.frombuffer(b"".join(levels.as_py()), np.uint8).astype(np.int64))
                read, read2 = every[: len(words)], every[len(words) :][back2]
                p_word = (read + ADD) / below
                before = np.empty(len(flat))
                before[0], before[1:] = read[np.searchsorted(words, np.uint64(END))], read[back[:-1]]
                p = np.minimum((np.minimum(read2, before) + MU * p_word[back]) / (before + MU), 1.0)
                rare = ~found[back]
                n_rare = np.add.reduceat(rare.astype(np.int64), starts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32())
                columns = [ids.values, held_out.values, pa.array(lens, pa.int64()), pa.array(lens - n_rare, pa.int64()), pa.array(np.add.reduceat(base[back], starts)), pa.array(np.add.reduceat(np.log10(p), starts))]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, pa.array(flat[rare].view(np.int64)))], ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"])
        release_memory()

    return run


def _drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles that nothing refers to any more; else they stay until the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score_documents(docs: DataFrame, trains: Column, *, top_words: int = TOP_WORDS) -> DataFrame:
    """Scores of (doc_id, text) rows by a model of the rows where ``trains`` holds: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), (~F.coalesce(trains, F.lit(False))).alias("held_out"), "text")
    chunked = rows.mapInArrow(_chunked, "ids array<bigint>, held_out array<boolean>, lens array<int>, words binary, at binary")
    with batch_rows(spark, 1_000):
        chunks = stored(chunked.withColumn("chunk", F.monotonically_increasing_id()), "chunks", large_rows=True)
    size = chunks.agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    parts = max(LEAST_PARTS, math.ceil(size / PART_TOKENS))
    with batch_rows(spark, _BATCH, LOT_BYTES):  # chunks are large rows, cells of a chunk and a part small ones
        counted = chunks.select("held_out", "lens", "words", "at").mapInArrow(_counted(parts), "part long, pair boolean, keys binary, n binary")
        model = stored(counted.groupBy("part").applyInArrow(_modelled, "part long, bits binary, words array<struct<key: bigint, n: bigint>>"), "model", large_rows=True)
        del counted
        _drop_shuffles(spark)
        words = model.select(F.inline("words"))
        n_train, n_distinct = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
        levels = words.groupBy(quantised(F.col("n")).alias("q")).agg(F.count("*").alias("n")).toPandas().sort_values("q", ascending=False)
        fits = levels["n"].cumsum().to_numpy() <= top_words
        lowest = int(levels["q"].to_numpy()[fits][-1]) if fits.any() else 1_000
        top = words.where(quantised(F.col("n")) >= lowest).toPandas()
        keys = top["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], top["n"].to_numpy(np.int64)[order]))
        asked = chunks.select("chunk", "lens", "words", "at").mapInArrow(_asked(parts), "part long, chunk long, data binary")
        asked = model.select("part", F.lit(None).cast("long").alias("chunk"), F.col("bits").alias("data")).unionByName(asked)
        asked = asked.repartition("part").sortWithinPartitions("part", F.col("chunk").asc_nulls_first())
        answers = stored(asked.mapInArrow(_answered, "chunk long, part long, levels binary"), "answers")
        del asked
        _drop_shuffles(spark)
        listed = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "levels")))["levels"].alias("levels"))
        run = _scored(shared, parts, n_train, n_distinct)
        answered = chunks.join(listed, "chunk").select("ids", "held_out", "lens", "words", "at", "levels")
        scored = answered.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<bigint>")
        scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        remove(chunks, answers)
    below = n_train + ADD * (n_distinct + 1)
    rest = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rest = rest.join(words.where(quantised(F.col("n")) < lowest), "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + F.lit(ADD)) / F.lit(below))).alias("base_rest"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known_rest"),
    )
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"),
        "score",
    )
