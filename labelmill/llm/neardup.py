"""MinHash near-dedup: a signature-coordinate inverted join, then exact set comparison inside candidate clusters.

1. One pass over the texts gives each document its set size, a 128-bit digest of its shingle set and a MinHash
   signature. Documents of equal sets collapse to their smallest doc_id, so copies never meet in pairs.
2. Every (coordinate, value) pair is a posting. Two signatures of k coordinates that agree in at least t of them share
   a posting among the k-t+1 rarest of either (prefix); postings that one document alone has are skipped.
3. The postings left are grouped in bounded blocks. Within a block collisions of whole signatures are counted and a
   spanning forest of the pairs with at least t is kept, so output stays linear in the block.
4. Components of that forest are candidate clusters. Their full shingle sets are compared, again in bounded blocks,
   and a spanning forest of the exact links gives the components.

A pair at the threshold 0.85 agrees in fewer than t = 37 of 64 coordinates with a probability below 1e-6; above it less.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, group_bounds, land, mix, shingle_sets, signed, strings, whole_groups
from .components import connected_components

COORDINATES = 64
#: Rows of one side of a block of postings, and of a block of full sets.
POSTING_BLOCK, SET_BLOCK = 1024, 512
#: Up to so many ids of clustered documents (16 MB) are broadcast to keep other texts out of the shuffle; more are joined.
BROADCAST_IDS = 2_000_000


def match_threshold(percent: int, k: int = COORDINATES) -> int:
    """Collisions out of k that a pair at the similarity has with near certainty: 5.75 standard deviations below the mean."""
    p = percent / 100
    return max(1, int(k * p - 5.75 * (k * p * (1 - p)) ** 0.5))


def signature_batches(batches: Iterable[pa.RecordBatch], width: int, k: int = COORDINATES) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text): set size, two digests of the set, and the k least hash values (null for an empty set)."""
    rng = np.random.default_rng(977)
    mul = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, k, dtype=np.uint64)
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for a, b, part, off in byte_chunks(data, offsets):
            flat, at = shingle_sets(part, off, width)
            size = np.diff(at)
            some = np.flatnonzero(size)
            digest = np.zeros((2, b - a), dtype=np.uint64)
            sig = np.zeros((len(some), k), dtype=np.uint32)
            if len(some):
                starts = at[some]
                digest[0, some] = np.add.reduceat(mix(flat ^ np.uint64(0x51ED270B)), starts)
                digest[1, some] = np.add.reduceat(mix(flat * np.uint64(0xC2B2AE3D27D4EB4F)), starts)
                for j in range(k):
                    sig[:, j] = np.minimum.reduceat(flat * mul[j] + add[j], starts) >> np.uint64(32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum((size > 0) * k)).astype(np.int32)), pa.array(sig.view(np.int32).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(size), pa.array(signed(digest[0])), pa.array(signed(digest[1])), lists],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )


def set_batches(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """From (doc_id, cluster, nb, text): the full shingle set as bytes of 64-bit hashes."""
    for batch in batches:
        data, offsets = strings(batch.column("text"))
        for a, b, part, off in byte_chunks(data, offsets):
            flat, at = shingle_sets(part, off, width)
            raw = flat.tobytes()
            sets = pa.array([raw[x * 8 : y * 8] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(a, b - a) for c in ("doc_id", "cluster", "nb")), sets], names=["doc_id", "cluster", "nb", "hashes"]
            )


def _forest(n: int, matches) -> list[tuple[int, int]]:
    """A spanning forest of the graph on 0..n-1: matches(i, rest) gives which of `rest` link with i."""
    rest, out = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = matches(i, rest)
            found = rest[hit]
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
            rest = rest[~hit]
    return out


def _edges(doc: np.ndarray, pairs: list[np.ndarray]) -> pa.RecordBatch:
    ij = np.concatenate(pairs) if pairs else np.zeros((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(doc[ij[:, 0]]), pa.array(doc[ij[:, 1]])], names=["a", "b"])


def collision_batches(batches: Iterable[pa.RecordBatch], threshold: int, keys: list[str], k: int = COORDINATES) -> Iterator[pa.RecordBatch]:
    """Forest edges of the pairs of one posting block whose signatures agree in at least `threshold` coordinates."""
    for tab in whole_groups(batches, keys):
        tab = tab.combine_chunks()
        doc, bounds = tab.column("doc_id").to_numpy(), group_bounds(tab, keys)
        sig = tab.column("sig").chunk(0).flatten().to_numpy().reshape(-1, k)
        size, pairs = np.diff(bounds), []
        for m in np.unique(size[(size > 1) & (size <= 24)]):  # all groups of one small size at once
            i, j = np.triu_indices(int(m), 1)
            for part in np.array_split(bounds[:-1][size == m], max(1, (size == m).sum() * len(i) // 100_000)):
                x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                hit = (sig[x] == sig[y]).sum(axis=1) >= threshold
                pairs.append(np.stack([x[hit], y[hit]], axis=1))
        for g in np.flatnonzero(size > 24):
            lo = int(bounds[g])
            block = sig[lo : int(bounds[g + 1])]
            tree = _forest(len(block), lambda i, rest, block=block: (block[rest] == block[i]).sum(axis=1) >= threshold)
            if tree:
                pairs.append(np.array(tree, dtype=np.int64) + lo)
        yield _edges(doc, pairs)


def exact_batches(batches: Iterable[pa.RecordBatch], percent: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Forest edges of the pairs of one cluster block with 100 * intersection >= percent * union, on full sets."""
    for tab in whole_groups(batches, keys):
        doc, bounds = tab.column("doc_id").to_numpy(), group_bounds(tab, keys)
        hashes, pairs = tab.column("hashes"), []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo < 2:
                continue
            sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in hashes.slice(lo, hi - lo)]
            size = np.array([len(x) for x in sets])
            _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            at = np.append(0, np.cumsum(size))
            mark = np.zeros(len(df) + 1, dtype=bool)

            def matches(i, rest, code=code, at=at, size=size, mark=mark):
                own = code[at[i] : at[i + 1]]
                near = (size[rest] * 100 >= percent * size[i]) & (size[i] * 100 >= percent * size[rest])
                hit = np.zeros(len(rest), dtype=bool)
                some = rest[near]
                if len(some):
                    mark[own] = True
                    span = size[some]
                    offs = np.append(0, np.cumsum(span))[:-1]
                    flat = np.arange(span.sum()) + np.repeat(at[some] - offs, span)
                    inter = np.add.reduceat(mark[code[flat]].astype(np.int64), offs)
                    mark[own] = False
                    hit[near] = 100 * inter >= percent * (size[i] + span - inter)
                return hit

            tree = _forest(hi - lo, matches)
            if tree:
                pairs.append(np.array(tree, dtype=np.int64) + lo)
        yield _edges(doc, pairs)


def in_blocks(df: DataFrame, key: str, nb: str = "nb") -> DataFrame:
    """Each row once for every pair of blocks lo <= hi of its key that holds the row's own block; nb blocks a key."""
    own = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col(nb))
    return (
        df.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(nb) - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .filter((F.col(nb) == 1) | (F.col("lo") < F.col("hi")))
        .drop("own", "other", nb)
    )


def sorted_blocks(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*[F.col(c) for c in keys]).sortWithinPartitions(*keys)


def candidate_edges(reps: DataFrame, threshold: int, k: int = COORDINATES) -> DataFrame:
    """(a, b): a spanning forest of the pairs of (doc_id, sig) that agree in at least `threshold` of k coordinates."""
    posted = reps.select("doc_id", F.posexplode("sig").alias("i", "value")).select("doc_id", F.xxhash64("i", "value").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = posted.join(shared, "token").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
    room = F.lit(k - threshold + 1 - k) + F.size("ts")  # the coordinates of no other document come first
    prefix = land(
        ordered.withColumn("room", room).filter("room > 0")
        .select("doc_id", F.explode(F.slice("ts", F.lit(1), F.col("room"))).alias("t")).select("doc_id", "t.token")
    )
    lists = prefix.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token", F.ceil(F.col("n") / POSTING_BLOCK).alias("nb"))
    blocks = in_blocks(prefix.join(lists, "token").join(reps.select("doc_id", "sig"), "doc_id"), "token")
    keys = ["token", "lo", "hi"]
    return sorted_blocks(blocks, keys).mapInArrow(lambda it: collision_batches(it, threshold, keys, k), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of (doc_id bigint, text string, ...).

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; texts link with 100 * intersection >= percent * union of
    their sets of `width`-word shingles. component_id is the smallest doc_id reachable, kept marks it. Null or empty
    texts have n_shingles 0 and link with nothing; a null doc_id takes no part, has a null component and is kept;
    rows repeating a doc_id share a component, except those without shingles, whose component is their doc_id. Other columns of docs are not read. An empty table gives no rows."""
    found = land(docs.select("doc_id", "text").mapInArrow(lambda it: signature_batches(it, width), "doc_id long, n_shingles long, d1 long, d2 long, sig array<int>"))
    linked = found.filter("n_shingles > 0 and doc_id is not null")
    rep = linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    reps = linked.join(rep, ["d1", "d2"]).filter("doc_id = rep").select("doc_id", "sig")
    near = connected_components(candidate_edges(land(reps), match_threshold(percent)))
    clusters = near.groupBy("component").agg(F.ceil(F.count("*") / SET_BLOCK).alias("nb"))
    asked = near.join(clusters, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "nb")
    texts = docs.select("doc_id", "text")
    if near.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(near.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    sets = asked.join(texts, "doc_id").mapInArrow(lambda it: set_batches(it, width), "doc_id long, cluster long, nb long, hashes binary")
    keys = ["cluster", "lo", "hi"]
    exact = sorted_blocks(in_blocks(sets, "cluster"), keys).mapInArrow(lambda it: exact_batches(it, percent, keys), "a long, b long")
    component = connected_components(exact)
    own = (
        linked.join(rep.filter("n > 1"), ["d1", "d2"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
        .join(component, F.col("rep") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    )
    rest = found.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
