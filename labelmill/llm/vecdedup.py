"""Embedding near-dedup by sorted projection passes.

Each pass gives every distinct vector the signs of random projections, orders the vectors of a label
lexicographically by them, and compares each with its neighbours in a bounded window. Verified pairs of all passes
are united. What the windows leave out is then done exactly: inside each united group all pairs are compared, in
bounded blocks, to count every link. A link is missed only if no chain of window pairs joins its two vectors.

The number of passes follows from the largest label: two vectors at the least cosine agree in a sign with probability
p, and lie in one window if they agree in the first log2(rows / window) signs or so.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import _matrix, usable
from .common import group_bounds, land, whole_groups
from .components import connected_components
from .neardup import _forest, sorted_blocks

WINDOW, BITS, GROUP_BLOCK = 64, 60, 512
#: Rows that make a vector frequent: a share of all.
OFTEN = 1000
#: Chance that no pass puts a pair at the threshold into one window, for vectors that are spread evenly; passes at least.
MISS, LEAST_PASSES = 1e-5, 16


def passes_for(rows: int, least: float, window: int = WINDOW) -> int:
    """Passes that a label of so many rows needs."""
    agree = 1 - np.arccos(min(1.0, max(-1.0, least))) / np.pi
    together = agree ** max(0.0, np.log2(max(1, rows) / window))
    return max(LEAST_PASSES, int(np.ceil(np.log(MISS) / np.log1p(-min(together, 1 - 1e-9)))))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to 0.5 .. 1: squares neither over- nor underflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def keyed_batches(batches: Iterable[pa.RecordBatch], passes: int, seed: int = 11) -> Iterator[pa.RecordBatch]:
    """Each (id, label, v) once for every pass, with its concatenated projection signs as one sortable number."""
    planes: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        size = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        borders = np.union1d(np.flatnonzero(np.diff(size, prepend=-1)), np.arange(0, batch.num_rows, 512))
        for a, b in zip(borders.tolist(), [*borders[1:].tolist(), batch.num_rows]):  # vectors of one length
            part = batch.slice(a, b - a)
            x = _scaled(_matrix(part.column("v")))
            if x.shape[1] not in planes:
                planes[x.shape[1]] = np.random.default_rng(seed).normal(size=(x.shape[1], passes * BITS))
            sign = ((x @ planes[x.shape[1]]) > 0).reshape(len(x), passes, BITS)
            keys = sign @ weights
            for p in range(passes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), p, dtype=np.int32)), part.column("label"), pa.array(keys[:, p]), part.column("id"), part.column("v")],
                    names=["pass", "label", "key", "id", "v"],
                )


def _pairs(tab: pa.Table, least: float, window: int) -> pa.RecordBatch:
    """Links of each row with the next `window` rows of its pass and label, thinned to a forest where they are many."""
    order, label, ids = tab.column("pass").to_numpy(), tab.column("label").to_numpy(), tab.column("id").to_numpy()
    x, size = _unit(_matrix(tab.column("v"))), pc.list_value_length(tab.column("v")).to_numpy()
    out = []
    for a in range(0, len(x), 256):
        b = min(len(x), a + 256 + window)
        i, j = np.nonzero(x[a : min(a + 256, len(x))] @ x[a:b].T >= least)
        near = (j > i) & (j - i <= window) & (order[a + i] == order[a + j]) & (label[a + i] == label[a + j]) & (size[a + i] == size[a + j])
        i, j = i[near], j[near]
        if len(i) > 2 * (b - a):
            link = np.zeros((b - a, b - a), dtype=bool)
            link[i, j] = link[j, i] = True
            tree = np.array(_forest(b - a, lambda r, rest, link=link: link[r, rest]), dtype=np.int64).reshape(-1, 2)
            i, j = tree[:, 0], tree[:, 1]
        out.append(np.stack([ids[a + i], ids[a + j]], axis=1))
    both = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def window_batches(batches: Iterable[pa.RecordBatch], least: float, window: int) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition: its window pairs (a, b), and its first and last `window` rows under the border they lie at."""
    border, first, last = TaskContext.get().partitionId(), [], []
    empty = None

    def at(number: int, rows: pa.RecordBatch) -> pa.RecordBatch:
        ends = [pa.nulls(rows.num_rows, pa.int64())] * 2
        return pa.RecordBatch.from_arrays([*ends, pa.array(np.full(rows.num_rows, number, dtype=np.int64)), *rows.columns], names=["a", "b", "border", *rows.schema.names])

    for batch in batches:
        have = sum(b.num_rows for b in first)
        if have < window:
            first.append(batch.slice(0, window - have))
        tab = pa.Table.from_batches([*last, batch])
        pairs = _pairs(tab, least, window)
        empty = [pa.nulls(pairs.num_rows, f.type) for f in batch.schema]
        yield pa.RecordBatch.from_arrays([*pairs.columns, pa.nulls(pairs.num_rows, pa.int64()), *empty], names=["a", "b", "border", *batch.schema.names])
        last = tab.slice(max(0, tab.num_rows - window)).combine_chunks().to_batches()
    for rows in first:
        yield at(border - 1, rows)
    for rows in last:
        yield at(border, rows)


def border_pairs(batches: Iterable[pa.RecordBatch], least: float, window: int) -> Iterator[pa.RecordBatch]:
    for tab in whole_groups(batches, ["border"]):
        bounds = group_bounds(tab, ["border"])
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield _pairs(tab.slice(lo, hi - lo), least, window)


def link_batches(batches: Iterable[pa.RecordBatch], least: float, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Of each block pair of a group: how many rows, copies counted, each vector links with."""
    for tab in whole_groups(batches, keys):
        bounds = group_bounds(tab, keys)
        ids, copies, own = (tab.column(c).to_numpy() for c in ("doc_id", "copies", "own"))
        lo_key, hi_key = tab.column("lo").to_numpy(), tab.column("hi").to_numpy()
        x, n = _unit(_matrix(tab.column("v"))), np.zeros(tab.num_rows, dtype=np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            link = x[a:b] @ x[a:b].T >= least
            np.fill_diagonal(link, False)
            if lo_key[a] != hi_key[a]:
                link &= own[a:b][:, None] != own[a:b][None, :]
            n[a:b] = link @ copies[a:b]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["doc_id", "n"])


def linked_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row: links join rows of one label with cosine >= least.

    Equal vectors collapse first and are counted in n_links. Vectors of different lengths never link. Rows with a null key or label, and vectors that are null,
    empty, zero or hold null or non-finite components, link with nothing: they are their own component and kept. Rows
    repeating a key are vectors of their own, each with its own links. An empty table gives no rows; other columns are not read."""
    spark = rows.sparkSession
    slim = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fit = usable("v") & F.col("id").isNotNull() & F.col("label").isNotNull()
    good, rest = slim.filter(fit), slim.filter(~F.coalesce(fit, F.lit(False)))
    distinct = land(good.groupBy("label", "v").agg(F.min("id").alias("key"), F.count("*").alias("copies")).withColumn("id", F.col("key")))
    shared = distinct.groupBy("key").count().filter("count > 1").select("key")
    apart = shared.limit(1).count() > 0
    if apart:  # different vectors of one key are nodes of their own
        other = F.row_number().over(Window.partitionBy("key").orderBy("label", "v")) > 1
        some = distinct.join(shared, "key", "left_semi").withColumn("id", F.when(other, F.xxhash64("key", "label", "v")).otherwise(F.col("key")))
        distinct = land(distinct.join(shared, "key", "left_anti").unionByName(some))
    sizes = distinct.groupBy("label").count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    often = F.broadcast(distinct.filter(F.col("copies") > F.lit((distinct.agg(F.sum("copies")).first()[0] or 0) / OFTEN)).select("label", "v"))
    if passes is None:
        passes = passes_for(sizes["most"] or 0, least, window)
    most = (sizes["n"] or 0) * passes // (8 * window) + 1  # partitions far wider than the window
    parts = min(most, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = "pass int, label long, key long, id long, v array<double>"
    order = ["pass", "label", "key", "id"]
    ordered = distinct.select("id", "label", "v").mapInArrow(lambda it: keyed_batches(it, passes), row).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    compared = land(ordered.mapInArrow(lambda it: window_batches(it, least, window), f"a long, b long, border long, {row}"))
    met = compared.filter("border is not null").drop("a", "b").repartition("border").sortWithinPartitions("border", *order)
    across = met.mapInArrow(lambda it: border_pairs(it, least, window), "a long, b long")
    inside = compared.filter("a is not null").select("a", "b")
    groups = connected_components(inside.unionByName(across))
    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / GROUP_BLOCK).alias("nb"))
    members = (
        groups.join(blocks, "component").join(distinct, F.col("node") == F.col("id"))
        .select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "nb", "copies", "v")
        .withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("nb")))
    )
    keys = ["cluster", "lo", "hi"]
    blocked = (
        members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("nb") - 1)))
        .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "nb")
    )
    links = sorted_blocks(blocked, keys).mapInArrow(lambda it: link_batches(it, least, keys), "doc_id long, n long").groupBy("doc_id").agg(F.sum("n").alias("n"))
    named = groups.withColumn("least", F.col("component"))  # a node is its key
    if apart:
        least = groups.join(distinct.select(F.col("id").alias("node"), "key"), "node").groupBy("component").agg(F.min("key").alias("least"))
        named = groups.join(least, "component")
    found = land(distinct.join(links, F.col("id") == F.col("doc_id"), "left").join(named, F.col("id") == F.col("node"), "left").select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "key").alias("component_id")
    ))
    # a vector with more than a 1/OFTEN of all rows, of which there are fewer than OFTEN, is joined by broadcast
    of = ["label", "v"]
    met = good.join(F.broadcast(found.join(often, of, "left_semi")), of).unionByName(good.join(often, of, "left_anti").join(found, of))
    out = met.select(F.col("id").alias(key), "n_links", "component_id")
    alone = rest.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
