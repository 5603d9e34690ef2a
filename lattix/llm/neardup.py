"""Near-duplicate documents by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A document's set holds the hashes of its distinct ``width``-word shingles.  One permutation fills 128 bins (a bin's
value is the least hash in it); an empty bin borrows from the first filled bin in its own fixed random order of all
bins, which is the optimal densification.  Bands of four bins are the bucket keys.

1. Documents with one and the same set form a class; only its smallest id goes on.  Copies are never paired.
2. In a bucket, all members are paired with one centre, the smallest id: as many pairs as members, at most.
3. Pairs that an odd sketch (the parities of the set's hashes in 1,024 cells, whose difference tells the size of
   the symmetric difference) shows to be too far apart, by five standard deviations, are left out; the others are
   confirmed on full sets, and confirmed pairs joined to components.
4. A star can miss a link between two members that are both too far from its centre, which matters only where a
   bucket still holds several components.  The documents of such buckets, however large these are, are joined exactly,
   by prefixes: shingles that occur in one component only come first, then the others from the rarest on, and two
   documents of different components can be linked only if they share one of their first n - ceil(t * n) + 1.  A
   document with fewer than t * n shingles in common with other components meets nobody.  Where one shingle still
   brings very many together, its members are dealt to blocks of about ``MAX_GROUP`` (those of its largest component
   apart, as they need no pairs among themselves), so no group of work is larger than two blocks.

With 32 bands of four bins a pair at similarity 0.75 shares no bucket with probability (1 - 0.75**4)**32 = 5e-6.
Sets are compared by 64-bit hashes of shingles.

Defined results: a null or empty text has an empty set and is linked with nothing; texts with fewer words than a
shingle have their whole sequence as the only element; rows with equal ids are one node; a null id is in no component
and kept; repeated rows are repeated; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import batch_rows, lots, release_memory, remove, stored
from lattix.llm.components import connected_components

BINS, ROWS = 128, 4
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_ORDERS = np.argsort(np.random.default_rng(2017).random((BINS, BINS)), axis=1)  # every bin's own order of all bins
CELLS, MAX_GROUP = 1_024, 1_024
#: Up to so many documents are pointed out to the scan by a bitmap (8 bits each, so 8 MB); more are joined.
MAX_ASKED = 1 << 23
#: Shingles by which a pair is recognised as one that has been taken.
HEAD = 32
#: Members that meet one copy of their centre's set.
LOT_MEMBERS = 256


class _Hashes(dict):
    """Hashes of the words seen by this worker; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()
_hash_of = _hashes.__getitem__


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hash_of, words), np.uint64, n)
    k = min(n, width)
    odd = _ODD[:k] if width <= 5 else mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.full(n - k + 1, k * 0x9FB21C651E98DF25 & (2**64 - 1), np.uint64)
    for i in range(k):
        h += w[i : n - k + 1 + i] * odd[i]
    return np.unique(mixed(h))


def signature(s: np.ndarray) -> np.ndarray:
    """The bins' values; ``s`` is sorted, so the first element of a bin is its least."""
    edges = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(57))
    filled = np.append(edges[1:], len(s)) > edges
    values = s[np.minimum(edges, len(s) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = _ORDERS[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return values


def bands(s: np.ndarray) -> np.ndarray:
    v = signature(s).reshape(-1, ROWS)
    h = np.arange(1, len(v) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        h = mixed(h ^ v[:, i]) + _ODD[i]
    return h


def odd_sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            n, f1, f2, keys, sketches = [], [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py(), width)
                n.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                f2.append(int(np.bitwise_xor.reduce(mixed(s + np.uint64(len(s))))) if len(s) else 0)
                keys.append(bands(s).view(np.int64) if len(s) else None)
                sketches.append(odd_sketch(s))
            lens = np.array([0 if k is None else len(k) for k in keys])
            flat = np.concatenate([k for k in keys if k is not None]) if lens.any() else np.empty(0, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(lens)]), pa.int32())
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (CELLS // 64), pa.int32()), pa.array(np.concatenate(sketches) if n else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n, pa.int64()), as_long(f1), as_long(f2), pa.ListArray.from_arrays(offsets, pa.array(flat)), cells],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "sketch"],
            )
        _hashes.clear()
        release_memory()

    return run


def _sets(shared, width: int):
    """(id, set) of (id, bit, text) rows whose bit is set in the shared bitmap; of all rows without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value if shared else None
        for batch in batches:
            if bitmap is not None:
                bit = batch.column(1).to_numpy(zero_copy_only=False)
                batch = batch.take(pa.array(np.flatnonzero((bitmap[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))))
            ids = batch.column(0).cast(pa.int64())
            for start, texts in lots(batch.column(2)):
                sets = [shingles(t, width).view(np.int64) for t in texts]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets)))], ["id", "set"])
        _hashes.clear()
        release_memory()

    return run


def _asked_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set) of the documents listed in ``ids`` (column id, distinct).  Up to ``MAX_ASKED`` of them are marked in a
    bitmap, so that few other sets are made and shuffled; beyond that, the texts are joined with the ids."""
    spark = docs.sparkSession
    n = ids.count()
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    if n > MAX_ASKED:
        texts = source.join(ids, "id", "left_semi").select("id", F.lit(0).cast("long").alias("bit"), "text")
        return texts.mapInArrow(_sets(None, width), "id long, set array<bigint>").dropDuplicates(["id"])
    bits = 1 << max(20, (8 * n - 1).bit_length())
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(bit.alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    sets = source.select("id", bit.alias("bit"), "text").mapInArrow(_sets(spark.sparkContext.broadcast(bitmap), width), "id long, set array<bigint>")
    return sets.join(ids, "id", "left_semi").dropDuplicates(["id"])


def _meeting(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The linked (a, b); rows (a, lot, b, set) come in order, a lot's first one without b and with the set of a."""
        centre = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, _, b, s in zip(*batch.columns, strict=True):
                own = s.values.to_numpy(zero_copy_only=False).view(np.uint64)
                if not b.is_valid:
                    centre = own
                    continue
                at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                both = int((centre[at] == own).sum())
                if 100 * both >= percent * (len(centre) + len(own) - both):
                    found.append((a.as_py(), b.as_py()))
            x, y = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])
        release_memory()

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of distinct ``pairs`` that reach the threshold on full sets.  The members of a centre come to it in lots
    by their ids, with one copy of the centre's set for each lot and not for each pair."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / LOT_MEMBERS).cast("int").alias("lots"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), "lots").cast("int").alias("lot"), "b")
    members = members.join(sets.select(F.col("id").alias("b"), "set"), "b").select("a", "lot", "b", "set")
    centres = sizes.join(sets.select(F.col("id").alias("a"), "set"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(None).cast("long").alias("b"), "set")
    rows = centres.unionByName(members).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_meeting(percent), "a long, b long")


def _near(a: str, b: str, percent: int) -> Column:
    """Whether two rows (n, sketch) can reach the threshold: by their sizes, exactly, and by their sketches.  At the
    threshold the symmetric difference has d = (na + nb) * (1 - t) / (1 + t) elements; the parities that it turns odd
    have a mean and a variance that follow from throwing d balls into the cells, and fewer for smaller d."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    d = (na + nb) * ((100 - percent) / (100 + percent))
    m = float(CELLS)
    one, two = F.pow(F.lit(1 - 2 / m), d), F.pow(F.lit(1 - 4 / m), d)
    variance = (m + m * (m - 1) * two - m * m * one * one) / 4
    odd = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(CELLS // 64)), F.lit(0))
    return sizes & (odd <= m / 2 * (1 - one) + 5 * F.sqrt(F.greatest(variance, F.lit(0.0))) + 2)


def _prefixes(sets: DataFrame, of: DataFrame, percent: int) -> DataFrame:
    """(s, id, of, head): the shingles on which documents of different components (id, of) must meet if they are to be linked,
    and the first few of them in the common order."""
    each = sets.join(of, "id").select("id", "of", F.size("set").alias("n"), F.explode("set").alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("df"), F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo < hi").select("s", "df")
    own = each.join(shared, "s").groupBy("id", "of", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("common"))
    need = F.ceil(F.col("n") * percent / 100).cast("int")
    own = own.select("id", "of", F.slice("common", F.lit(1), F.greatest(F.size("common") - need + 1, F.lit(0)))["s"].alias("prefix"))
    return own.select(F.explode("prefix").alias("s"), "id", "of", F.slice("prefix", 1, HEAD).alias("head"))


def _across(rows: DataFrame, known: DataFrame, percent: int, max_group: int) -> DataFrame:
    """The (a, b), a < b, of different components that meet on an s and whose sketches are near."""
    sums = rows.groupBy("s", "of").agg(F.count("*").alias("m")).groupBy("s").agg(F.count("*").alias("several"), F.max(F.struct("m", "of")).alias("main"), F.sum("m").alias("size")).where("several > 1")
    first = F.ceil(F.col("main.m") / max_group).cast("int")
    rest = F.ceil((F.col("size") - F.col("main.m")) / max_group).cast("int")
    x = rows.join(sums.select("s", F.col("main.of").alias("main"), first.alias("first"), rest.alias("rest")), "s").join(known, "id")
    block = F.when(F.col("of") == F.col("main"), F.pmod(F.hash("id"), "first")).otherwise(F.col("first") + F.pmod(F.hash("id"), "rest"))
    others = F.sequence(F.when(F.col("of") == F.col("main"), F.col("first")).otherwise(0), F.col("first") + F.col("rest") - 1)
    x = stored(x.withColumn("block", block), "compared").withColumn("other", F.explode(others))
    a, b = x.alias("x"), x.alias("y")
    together = (F.col("x.s") == F.col("y.s")) & (F.col("x.block") == F.col("y.other")) & (F.col("x.other") == F.col("y.block"))
    # of all shingles that a pair shares, it is taken at the first, unless that is behind both heads
    shared = F.array_intersect("x.head", "y.head")
    once = (F.size(shared) == 0) | (F.col("x.s") == F.get(shared, F.lit(0)))
    pairs = a.join(b, together & (F.col("x.of") != F.col("y.of")) & (F.col("x.id") < F.col("y.id")) & _near("x", "y", percent) & once)
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 75, max_group: int = MAX_GROUP) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id and kept."""
    with batch_rows(docs.sparkSession, 1_000):
        return _near_duplicates(docs, width, percent, max_group)


def _near_duplicates(docs: DataFrame, width: int, percent: int, max_group: int) -> DataFrame:
    signed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signatures(width), "doc_id long, n_shingles long, f1 long, f2 long, bands array<bigint>, sketch array<bigint>")
    sig = stored(signed, "signatures")
    usable = sig.where("doc_id is not null and n_shingles > 0")
    key = ["n_shingles", "f1", "f2"]
    reps = usable.groupBy(*key).agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    reps = stored(reps, "classes")
    spread = reps.select(F.explode("bands").alias("bucket"), "id")
    crowded = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("centre")).where("size > 1")
    members = stored(spread.join(crowded, "bucket"), "members")
    known = reps.select("id", F.col("n_shingles").alias("n"), "sketch")

    stars = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(known.alias("x"), F.col("a") == F.col("x.id")).join(known.alias("y"), F.col("b") == F.col("y.id"))
    stars = stored(stars.where(_near("x", "y", percent)).select("a", "b"), "pairs")
    asked = stored(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
    sets = stored(_asked_sets(docs, asked, width), "sets")
    links = stored(_linked(stars, sets, percent), "links")
    remove(stars, asked, sets)
    labels = stored(connected_components(links), "labels")

    placed = members.select("bucket", "id").join(labels, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("of"))
    several = placed.groupBy("bucket").agg(F.min("of").alias("lo"), F.max("of").alias("hi")).where("lo < hi").select("bucket")
    open_ = stored(placed.join(several, "bucket", "left_semi").select("id", "of").distinct(), "open")
    sets = stored(_asked_sets(docs, open_.select("id"), width), "sets")
    pairs = stored(_across(_prefixes(sets, open_, percent), known, percent, max_group), "pairs")
    more = stored(_linked(pairs, sets, percent), "links")
    remove(members, open_, sets, pairs, labels)
    labels = stored(connected_components(links.unionByName(more)), "labels")
    remove(links, more)

    classes = reps.select(*key, F.col("id").alias("class_id")).join(labels, F.col("class_id") == F.col("node"), "left").select(*key, "class_id", F.coalesce("component", "class_id").alias("component"))
    out = sig.select("doc_id", *key).join(classes, key, "left")
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
