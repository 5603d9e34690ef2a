"""Approximate nearest neighbours by largest inner product, over low-dimensional stable projections.

Vectors are lengthened by one component so that all have the largest norm; the nearest by Euclidean distance are then
those with the largest inner product.  They are indexed in a Gaussian (2-stable) projection to ``dims`` dimensions:

1. A kd-tree cuts the projected space into up to ``MAX_CELLS`` cells of about ``block_rows`` rows.  Its cuts are medians
   of at most ``sample_rows`` rows, those with the smallest hashes of their ids (a documented bound); all rows are then
   put into its cells, and cells that turn out larger hold several chunks.
2. Every chunk is indexed once: its rows in the order of a kd-tree's leaves, and the leaves' boxes.
3. Queries go to the cells in the order of their distance in the projection, in rounds: the nearest one, the next
   seven, all others.  After each round a query knows its k-th best so far, and goes on only to cells and leaves
   that the chi-square test leaves open: if a row at that distance would be projected to nearer than the box with
   probability ``confidence``, the box is unlikely to hold a better one.  Rows of visited leaves are verified by exact
   inner products.

Queries meet chunks in packs of ``query_rows``, so memory is bounded whatever the number of rows or the crowd in one cell,
and each chunk returns k rows per query at most.  The cells' boxes are broadcast: 16 numbers for each of ``MAX_CELLS``.

The fewer the rows nearer than the boxes, the less is visited: vectors of equal norms in clusters leave most leaves alone,
while nearly isotropic ones, or norms that differ much (the added component then parts rows from all queries alike),
leave few.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; rows with equal ids count as one, with the least vector; queries only meet candidates with as many
components; equal scores are ordered by id; fewer candidates than k give all; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattix.llm.common import batch_rows, remove, stored

LEAF_ROWS, MAX_CELLS = 256, 1 << 16
#: Cells that a query visits in each round, nearest first; the last round takes all that are left.
ROUNDS = (0, 1, 8, MAX_CELLS)


def chi_square_quantile(p: float, k: int) -> float:
    """x with P(chi-square with k degrees <= x) = p, from the series of the incomplete gamma function."""

    def cdf(x: float) -> float:
        a, z = k / 2, x / 2
        term = total = 1 / a
        for n in range(1, 2000):
            term *= z / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return total * math.exp(a * math.log(z) - z - math.lgamma(a)) if z > 0 else 0.0

    low, high = 0.0, 10.0 * k + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def kd_leaves(y: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Rows in leaf order and where the leaves begin: halves at the median of the widest dimension."""
    order, starts = [], []
    todo = [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf_rows:
            starts.append(sum(map(len, order)) if not starts else starts[-1] + len(order[-1]))
            order.append(rows)
            continue
        part = y[rows]
        d = np.argmax(part.max(0) - part.min(0))
        half = np.argpartition(part[:, d], len(rows) // 2)
        todo += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
    return np.concatenate(order), np.array(starts, np.int64)


def _projection(dim: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim + 1, dims))


def _lengthened(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))[:, None]])


def fit_cells(y: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and cut of every inner node of a complete binary tree with ``2 ** levels`` leaves: medians of the widest
    dimension.  A row with a larger value goes right."""
    dims, cuts = np.zeros((1 << levels) - 1, np.int32), np.full((1 << levels) - 1, np.inf)
    rows = {0: np.arange(len(y))}
    for node in range(len(dims)):
        mine = rows.pop(node)
        if len(mine) > 1:
            part = y[mine]
            dims[node] = d = np.argmax(part.max(0) - part.min(0))
            cuts[node] = np.median(part[:, d])
        right = y[mine, dims[node]] > cuts[node]
        rows[2 * node + 1], rows[2 * node + 2] = mine[~right], mine[right]
    return dims, cuts


def cells_of(y: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dims, cuts = tree
    node = np.zeros(len(y), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (y[np.arange(len(y)), dims[node]] > cuts[node])
    return node - len(dims)


def gaps(yq: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of projected queries to boxes."""
    out = np.zeros((len(yq), len(lo)))
    for d in range(yq.shape[1]):
        c = yq[:, d, None]
        out += np.maximum(np.maximum(lo[:, d] - c, c - hi[:, d]), 0) ** 2
    return out


def search_chunk(q_ids, q, bound, ids, x, starts, lo, hi, top: float, projection: np.ndarray, k: int, limit: float):
    """(query, row, score) arrays of each query's k best rows of a chunk, none below its bound, and how many rows were verified."""
    stops = np.append(starts[1:], len(ids))
    gap = gaps(np.hstack([q, np.zeros((len(q), 1))]) @ projection, lo, hi)
    visit = np.argsort(gap, axis=1)
    q_norm = np.einsum("ij,ij->i", q, q)
    best = np.full((len(q), k), -np.inf)
    best_at = np.full((len(q), k), -1, np.int64)
    active, verified = np.arange(len(q)), 0
    for step in range(len(starts)):
        leaf = visit[active, step]
        kth = q_norm[active] + top - 2 * np.maximum(best[active, -1], bound[active])  # squared distance of the k-th best
        go = gap[active, leaf] < limit * kth
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        by = np.argsort(leaf, kind="stable")
        active, leaf = active[by], leaf[by]
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        for mine in np.split(np.arange(len(active)), cuts):
            n, a = leaf[mine[0]], active[mine]
            rows = np.arange(starts[n], stops[n])
            verified += len(rows) * len(a)
            s = q[a] @ x[rows].T
            s[q_ids[a][:, None] == ids[rows][None]] = -np.inf
            # products of a whole leaf may differ in the last place from those of single rows
            better = s.max(1) >= np.maximum(best[a, -1], bound[a] - 1e-9 * (1 + abs(bound[a])))
            a, s = a[better], s[better]
            s = np.hstack([best[a], s])
            at = np.hstack([best_at[a], np.broadcast_to(rows, (len(a), len(rows)))])
            first = np.lexsort((np.where(at >= 0, ids[at], np.iinfo(np.int64).max), -s), axis=1)[:, :k]
            best[a], best_at[a] = np.take_along_axis(s, first, 1), np.take_along_axis(at, first, 1)
    i, j = np.nonzero(best > -np.inf)
    at = best_at[i, j]
    return q_ids[i], ids[at], np.einsum("ij,ij->i", q[i], x[at]), verified


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column(0).to_numpy(zero_copy_only=False)
    for d in np.unique(dims).tolist():
        yield d, batch if (dims == d).all() else batch.filter(pa.array(dims == d))


def _places(shared, dims: int, seed: int, top: float):
    """Rows with the number of their cell, or with their projections where no trees are shared yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, b in _by_dim(batch):
                y = _lengthened(_matrix(b.column(2), d), top) @ _projection(d, dims, seed)
                if shared is None:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(y.astype(np.float32)), pa.list_(pa.float32()))], ["dim", "id", "y"])
                else:
                    cell = cells_of(y, shared.value[d]) if d in shared.value else np.zeros(len(y), np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), b.column(1), b.column(2)], ["dim", "cell", "id", "v"])

    return run


def _packed_chunk(dims: int, seed: int, top: float):
    """One row of a chunk's ids, vectors and leaves, indexed."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["id"].to_numpy(np.int64)
        y = _lengthened(x, top) @ _projection(x.shape[1], dims, seed)
        order, starts = kd_leaves(y)
        y = y[order]
        lo, hi = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
        parts = {"ids": ids[order], "x": x[order], "starts": starts, "lo": lo, "hi": hi, "box": np.stack([lo.min(0), hi.max(0)])}
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]]} | {k: [v.tobytes()] for k, v in parts.items()})

    return run


def _routed(shared, dims: int, seed: int, top: float, limit: float, first: int, last: int):
    """(dim, cell, id, v, bound) of every query and cell that it still has to visit, of those between two ranks by distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, b in _by_dim(batch):
                cells, lo, hi = shared.value[d]
                q = _matrix(b.column(2), d)
                bound = b.column(3).to_numpy(zero_copy_only=False)
                yq = np.hstack([q, np.zeros((len(q), 1))]) @ _projection(d, dims, seed)
                step = max(1, 4_000_000 // len(cells))
                for a in range(0, len(q), step):
                    part = slice(a, a + step)
                    gap = gaps(yq[part], lo, hi)
                    order = np.argsort(gap, axis=1, kind="stable")[:, first:last]
                    kth = np.einsum("ij,ij->i", q[part], q[part]) + top - 2 * bound[part]
                    i, j = np.nonzero(np.take_along_axis(gap, order, 1) < limit * kth[:, None])
                    at = pa.array(i + a)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(cells[order[i, j]]), *(b.column(c).take(at) for c in (1, 2, 3))], ["dim", "cell", "id", "v", "bound"])

    return run


def _packed_queries(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "q_ids": [pdf["id"].to_numpy(np.int64).tobytes()], "q": [x.tobytes()], "bound": [pdf["bound"].to_numpy(np.float64).tobytes()]})


def _index(rows: DataFrame, sizes: dict[int, int], top: float, dims: int, block_rows: int, sample_rows: int, seed: int) -> DataFrame:
    """The chunks of all rows (dim, id, v); ``sizes`` holds the number of rows of each dim that needs more than one cell."""
    spark = rows.sparkSession
    trees = {}
    if sizes:
        share = F.element_at(F.create_map(*(F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, 1.2 * sample_rows / n)))), F.col("dim"))
        at = F.pmod(F.xxhash64(F.lit(seed + 5), "id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
        some = rows.where(F.col("dim").isin(list(sizes))).where(at < share).select("dim", "id", "v").mapInArrow(_places(None, dims, seed, top), "dim int, id long, y array<float>")
        rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(seed + 5), "id"), "id"))
        sample = some.withColumn("rank", rank).where(F.col("rank") <= sample_rows).select("dim", "y").toPandas()
        for d, part in sample.groupby("dim"):
            levels = min(int(math.log2(MAX_CELLS)), math.ceil(math.log2(sizes[d] / block_rows)))
            trees[int(d)] = fit_cells(np.stack(part["y"].to_numpy()).astype(np.float64), levels)
    placed = rows.select("dim", "id", "v").mapInArrow(_places(spark.sparkContext.broadcast(trees), dims, seed, top), "dim int, cell int, id long, v array<double>")
    placed = stored(placed, "placed")
    chunks = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks"))
    chunked = placed.join(F.broadcast(chunks), ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "id"), "chunks"))
    index = chunked.groupBy("dim", "cell", "chunk").applyInPandas(_packed_chunk(dims, seed, top), "dim int, cell int, ids binary, x binary, starts binary, lo binary, hi binary, box binary")
    out = stored(index, "index")
    remove(placed)
    return out


def _search(asked: DataFrame, index: DataFrame, top: float, dims: int, seed: int, k: int, limit: float, query_rows: int, verified) -> DataFrame:
    """(query_id, vec_id, score) of the routed queries in the chunks of their cells."""
    packs = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("packs"))
    asked = asked.join(F.broadcast(packs), ["dim", "cell"]).withColumn("pack", F.pmod(F.xxhash64(F.lit(4), "id"), "packs"))
    asked = asked.groupBy("dim", "cell", "pack").applyInPandas(_packed_queries, "dim int, cell int, q_ids binary, q binary, bound binary")
    pairs = asked.join(index, ["dim", "cell"]).select("dim", "q_ids", "q", "bound", "ids", "x", "starts", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, *parts in zip(*b.columns, strict=True):
                d = dim.as_py()
                kinds = (np.int64, np.float64, np.float64, np.int64, np.float64, np.int64, np.float64, np.float64)
                q_ids, q, bound, ids, x, starts, lo, hi = (np.frombuffer(p.as_buffer(), t) for p, t in zip(parts, kinds, strict=True))
                *found, n = search_chunk(q_ids, q.reshape(-1, d), bound, ids, x.reshape(-1, d), starts, lo.reshape(-1, dims), hi.reshape(-1, dims), top, _projection(d, dims, seed), k, limit)
                if verified is not None:
                    verified.add(n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = 20, dims: int = 8, confidence: float = 0.97, block_rows: int = 8_192, query_rows: int = 512,
    sample_rows: int = 1 << 16, seed: int = 1, verified=None,
) -> DataFrame:
    """(vec_id, embedding) rows to query_id, rank, vec_id and score, for the rows where ``is_query`` holds.  ``verified``, an
    accumulator, gets the number of inner products."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    rows = stored(rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q")).withColumn("dim", F.size("v")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
    top = float(rows.agg(F.max(norm)).first()[0] or 0) * (1 + 1e-12)
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).collect()}
    limit = chi_square_quantile(confidence, dims)
    with batch_rows(spark, 8_192):
        index = _index(rows, sizes, top, dims, block_rows, sample_rows, seed)
    boxes: dict[int, list] = {}
    for r in index.select("dim", "cell", "box").toLocalIterator():
        boxes.setdefault(r["dim"], []).append((r["cell"], np.frombuffer(r["box"]).reshape(2, -1)))
    by_cell = {}
    for d, found in boxes.items():
        cells, back = np.unique(np.array([c for c, _ in found], np.int32), return_inverse=True)
        lo, hi = np.full((len(cells), dims), np.inf), np.full((len(cells), dims), -np.inf)
        np.minimum.at(lo, back, np.stack([b[0] for _, b in found]))
        np.maximum.at(hi, back, np.stack([b[1] for _, b in found]))
        by_cell[d] = cells, lo, hi
    shared = spark.sparkContext.broadcast(by_cell)
    queries = rows.where("q").select("dim", "id", "v")
    best, no_bound = None, F.lit(float("-inf"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    most = max((len(c) for c, _, _ in by_cell.values()), default=1)
    for first, last in zip(ROUNDS, ROUNDS[1:], strict=False):
        if first and first >= most:
            break
        if best is None:
            asked = queries.withColumn("bound", no_bound)
        else:
            kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
            asked = queries.join(kth, F.col("id") == F.col("query_id"), "left").select("dim", "id", "v", F.coalesce("kth", no_bound).alias("bound"))
        with batch_rows(spark, 1_000):
            asked = stored(asked.mapInArrow(_routed(shared, dims, seed, top, limit, first, last), "dim int, cell int, id long, v array<double>, bound double"), "asked")
        with batch_rows(spark, 4):  # chunks are large rows
            found = _search(asked, index, top, dims, seed, k, limit, query_rows, verified)
            old = best
            best = stored((found if old is None else found.unionByName(old.select(found.columns))).withColumn("rank", rank).where(F.col("rank") <= k), "found")
            remove(asked, *([old] if old is not None else []))
    return best.select("query_id", "rank", "vec_id", "score")
