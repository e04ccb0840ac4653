"""Approximate nearest neighbours: a forest of random-projection trees and one priority queue over all of them.

The trees are fitted on a bounded sample; every row is then put into one leaf of each tree. A query opens leaves of
all trees in the order of one shared queue (the margin by which it misses a leaf), until it has opened its share of
leaves. Rows and queries meet in a leaf, in bounded blocks, where inner products are computed exactly in double
precision; the best of all leaves are ranked. The share of leaves is the least that reaches the wanted recall on the
sample's own queries, so data without structure opens many leaves and clustered data few.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import group_bounds, land, whole_groups

#: Rows that the trees are fitted on: one in EACH of all, between these bounds; trees; rows of the sample in a leaf at least.
SAMPLE, EACH, TREES, LEAF = (8192, 131_072), 32, 16, 48
#: Rows, and queries, of one block of a leaf.
BLOCK = 4096
#: Neighbours found that a task holds before it thins them.
HELD = 2_000_000
#: Pairs whose exact inner products are computed at once.
PAIRS = 32_768
RECALL = 0.96
SHARES = (0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0)


def usable(vector: str) -> Column:
    """Vectors without null or non-finite components, and not zero."""
    c = F.col(vector)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


@dataclass(frozen=True)
class Forest:
    depth: int
    directions: np.ndarray  # trees, inner nodes, dimensions
    cuts: np.ndarray  # trees, inner nodes
    opened: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x @ d.T - c for d, c in zip(self.directions, self.cuts)], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """For each row its leaf in each tree, numbered over the whole forest."""
        m, node = self.margins(x), np.zeros((len(x), len(self.cuts)), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.take_along_axis(m, node[:, :, None], 2)[:, :, 0] > 0)
        return node - (2**self.depth - 1) + np.arange(len(self.cuts)) * 2**self.depth

    def search(self, x: np.ndarray, opened: int) -> np.ndarray:
        """For each query the `opened` leaves nearest by margin: one queue holds the open branches of all trees."""
        inner, out = 2**self.depth - 1, np.empty((len(x), opened), dtype=np.int64)
        for i, m in enumerate(self.margins(x).tolist()):
            queue = [(0.0, t, 0) for t in range(len(m))]
            for k in range(opened):
                miss, tree, node = heapq.heappop(queue)
                while node < inner:
                    side = m[tree][node]
                    far = 2 * node + (1 if side > 0 else 2)
                    heapq.heappush(queue, (max(miss, abs(side)), tree, far))
                    node = 2 * node + (2 if side > 0 else 1)
                out[i, k] = node - inner + tree * 2**self.depth
        return out


def fit(rows: DataFrame, key: str, vector: str, k: int = 20, trees: int = TREES, sample: tuple[int, int] = SAMPLE, recall: float = RECALL, seed: int = 5) -> Forest | None:
    """A forest from a sample of the usable rows, picked by a hash of key and vector; None without any usable row.

    The sample, and with it the number of leaves, grows with the rows up to its bound; beyond it leaves grow."""
    total = rows.count()
    if not total:
        return None
    size = min(total, max(sample[0], min(sample[1], total // EACH)))
    draw = F.pmod(F.xxhash64(key, vector, F.lit(29)), F.lit(1 << 30))
    some = rows.withColumn("_d", draw).filter(F.col("_d") <= int((1 << 30) * min(1.0, 1.1 * size / total + 64 / total)))
    picked = sorted(some.select("_d", vector).collect(), key=lambda r: (r[0], r[1]))[:size]
    x = np.array([r[1] for r in picked], dtype=np.float64)
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    depth = max(0, int(np.log2(max(1, len(x) / LEAF))))
    directions = rng.normal(size=(trees, 2**depth - 1, x.shape[1]))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-12)
    cuts = np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        node = np.zeros(len(x), dtype=np.int64)
        for v in range(2**depth - 1):
            own = node == v
            p = x[own] @ directions[t, v]
            cuts[t, v] = np.median(p) if len(p) else 0.0
            node[own] = 2 * v + 1 + (p > cuts[t, v])
    forest = Forest(depth, directions, cuts, 0)
    asked = x[: min(128, len(x))]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, max(1, len(x) - 1))]
    home, most = forest.leaves(x), trees * 2**depth
    order = forest.search(asked, most)
    for share in SHARES:
        opened = max(trees, int(share * most))
        hit = np.mean([np.isin(home[b], order[i, :opened]).any(axis=1).mean() for i, b in enumerate(best)])
        if hit >= recall:
            break
    return Forest(depth, directions, cuts, opened)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors as rows; shorter ones are filled with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    size = np.diff(flat.offsets.to_numpy())
    x = flat.flatten().to_numpy()
    if not len(size) or (size == size[0]).all():
        return x.reshape(len(flat), -1).astype(np.float64)
    out = np.zeros((len(size), size.max()))
    out[np.arange(size.max()) < size[:, None]] = x
    return out


def placed_batches(batches: Iterable[pa.RecordBatch], forest: Forest, query: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            x = _matrix(part.column(1))
            leaf = forest.search(x, forest.opened) if query else forest.leaves(x)
            row = np.repeat(np.arange(len(x)), leaf.shape[1])
            for lo in range(0, len(row), 8192):
                at = pa.array(row[lo : lo + 8192])
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()[lo : lo + 8192]), part.column(0).take(at), part.column(1).take(at)], names=["leaf", "id", "v"])


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best rows, nearest first, ties to the smaller id; a pair met in several trees counts once."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    new = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))[: len(q)]
    q, v, s = q[new], v[new], s[new]
    first = np.append(True, q[1:] != q[:-1])[: len(q)]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return q[rank < k], v[rank < k], s[rank < k]


def _first_copies(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without those equal vectors that no query can need: of each vector the k + 1 smallest ids stay (one may ask)."""
    if len(x) <= k + 1:
        return np.arange(len(x))
    x = np.ascontiguousarray(x + 0.0)  # -0.0 is 0.0
    _, same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    g = same[order]
    first = np.append(True, g[1:] != g[:-1])
    new = first | np.append(True, ids[order][1:] != ids[order][:-1])  # rows that repeat an id count once
    number = np.cumsum(new)
    rank = number - np.maximum.accumulate(np.where(first, number, 0))
    return np.sort(order[new & (rank <= k)])


def best_batches(batches: Iterable[pa.RecordBatch], k: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Of the blocks of leaves that lie together: each query's k best rows, by exact inner products.

    What has been found is thinned to the best of each query whenever it passes HELD rows, and put out at the end."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def out(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(q), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (q, v, s)], names=["query_id", "vec_id", "score"])

    for tab in whole_groups(batches, keys):
        bounds = group_bounds(tab, keys)
        ids, asks = tab.column("id").to_numpy(), tab.column("query").to_numpy()
        x = _matrix(tab.column("v"))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            mid = lo + int((asks[lo:hi] == 0).sum())
            if mid in (lo, hi):
                continue
            few = lo + _first_copies(ids[lo:mid], x[lo:mid], k)
            rough = x[mid:hi] @ x[few].T
            rough[ids[mid:hi][:, None] == ids[few][None, :]] = -np.inf
            n = rough.shape[1]
            floor = np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(rough), -np.inf)
            floor = np.where(np.isfinite(floor), floor - 1e-9 * np.maximum(1, np.abs(floor)), -np.finfo(float).max)
            near = rough >= floor[:, None]  # with all ties of the k-th
            ends = np.cumsum(near.sum(axis=1))
            a = 0
            while a < len(near):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
                q, r = np.nonzero(near[a:b])
                q, r = mid + a + q, few[r]
                held.append(_best(ids[q], ids[r], (x[q] * x[r]).sum(axis=1), k))
                size += len(held[-1][0])
                a = b
        if size > HELD:
            held = [_best(*(np.concatenate(c) for c in zip(*held)), k)]
            size = len(held[0][0])
            if size > HELD // 2:  # very many queries: put out what there is
                yield from out(*held[0])
                held, size = [], 0
    if held:
        yield from out(*_best(*(np.concatenate(c) for c in zip(*held)), k))


def nearest(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, **fitting) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k rows of largest inner product found for every row that
    `queries` selects, itself left out; nearest first, ties to the smaller key. Fewer rows give fewer neighbours.

    Rows with a null key, and vectors that are null, empty, zero or hold null or non-finite components, take no part.
    Equal vectors are neighbours of one another like any others. Vectors of several lengths raise ValueError. An empty table
    gives no rows; other columns are not read."""
    spark = rows.sparkSession
    good = rows.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias(vector), queries.alias("_q"))
    longest = good.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if longest["a"] != longest["b"]:
        raise ValueError(f"vectors have {longest['a']} to {longest['b']} components")
    forest = fit(good, key, vector, k, **fitting)
    if forest is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = spark.sparkContext.broadcast(forest)  # bounded: trees x sample / LEAF directions
    schema = "leaf long, id long, v array<double>"
    base = good.select(key, vector).mapInArrow(lambda it: placed_batches(it, shared.value, False), schema)
    asked = good.filter("_q").select(key, vector).mapInArrow(lambda it: placed_batches(it, shared.value, True), schema)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias(name))  # at most one row a leaf of the forest

    base, asked = land(base), land(asked)
    size = land(blocks(base, "nb").join(blocks(asked, "nq"), "leaf"))
    one = F.pmod(F.xxhash64("id", F.lit(3)), F.col("nb")), F.pmod(F.xxhash64("id", F.lit(3)), F.col("nq"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nq") - 1)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1))
    held = base.join(F.broadcast(size), "leaf").select("leaf", one[0].alias("b"), every[0].alias("q"), F.lit(0).alias("query"), "id", "v")
    sought = asked.join(F.broadcast(size), "leaf").select("leaf", every[1].alias("b"), one[1].alias("q"), F.lit(1).alias("query"), "id", "v")
    keys = ["leaf", "b", "q"]
    met = held.unionByName(sought).repartition(*keys).sortWithinPartitions(*keys, "query")
    found = met.mapInArrow(lambda it: best_batches(it, k, keys), "query_id long, vec_id long, score double")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
