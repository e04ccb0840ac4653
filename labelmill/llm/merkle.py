"""A Merkle manifest of a data set that stores every eighth level of its trees and recomputes the others.

Rows become leaves, SHA-256 over all their columns. The leaves of a group, in order of their key, form a binary tree; the
groups' roots, in order of the group, form one more. Of a tree only the levels 0, 8, 16, ... are written, as aligned
subtrees: one row holds the up to 256 nodes below one node eight levels higher. Whoever needs a proof recomputes the seven
levels between from such a row, takes the siblings and forgets them again.

Going up, each stored level gives the next one. Going down, each subtree hands the siblings above it to the subtrees
below, joined by (group, number of the subtree), so both sides of every join have one row a key. Nothing depends on how
the rows spread over groups: positions come from range partitions and prefix counts, and equal rows are told apart by
their place in the landed table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land

#: Levels from one stored level to the next.
EVERY = 8


def field(value: Any) -> Any:
    """A column as it enters a leaf: `-` for null, else its length in UTF-8 bytes, `:` and its text."""
    text = F.col(value).cast("string") if isinstance(value, str) else value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(values: list) -> Any:
    """The 32 bytes of a leaf."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def height(n: int) -> int:
    """Levels above n leaves: while several nodes remain, every two become one, a last single one too."""
    return max(0, n - 1).bit_length()


def levels(nodes: list[bytes], up: int) -> list[list[bytes]]:
    """The nodes (as hexadecimal text) and the `up` levels above them."""
    out = [nodes]
    for _ in range(up):
        now = out[-1]
        out.append([hashlib.sha256(b"".join(now[i : i + 2])).hexdigest().encode() for i in range(0, len(now), 2)])
    return out


def siblings(tree: list[list[bytes]], i: int) -> bytes:
    """The siblings of leaf i of a subtree, from below: L or R (its side) and 64 characters each, `-` where there is none."""
    out = []
    for nodes in tree[:-1]:
        other = i ^ 1
        out.append((b"L" if other < i else b"R") + nodes[other] if other < len(nodes) else b"-")
        i >>= 1
    return b"".join(out)


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, sibling) of each level of a path."""
    at = 0
    while at < len(path):
        size = 1 if path[at : at + 1] == b"-" else 65
        yield path[at : at + 1], path[at + 1 : at + size]
        at += size


def folded(node: bytes, path: bytes) -> bytes:
    """The root that a node and its siblings lead to."""
    for side, other in steps(path):
        node = hashlib.sha256(other + node if side == b"L" else node + other).hexdigest().encode()
    return node


def _hexed(packed: bytes) -> list[bytes]:
    text = packed.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _place(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in order get their part and their place among the part's rows of the group."""
    part, group, at = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        own = []
        for g in batch.column("g").to_pylist():
            at = at + 1 if g == group else 0
            group = g
            own.append(at)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64()), *[batch.column(k) for k in schema.names[2:]]], schema=schema)


def _pack(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each (g, block) of rows sorted by them and by position."""
    names = ["g", "block", "n", "key", "leaf", "other"]
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in names)))
    out, held = [], 0
    for (g, block), group in groupby(rows, key=lambda r: r[:2]):
        _, _, n, keys, leaves, others = zip(*group)
        out.append({"g": g, "block": block, "n": n[0], "keys": list(keys), "nodes": b"".join(leaves), "others": list(others)})
        held += len(keys)
        if held >= 1 << 16:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """A few stored subtrees at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            yield batch.slice(a, 256).to_pylist()


def _up(batches: Iterable[pa.RecordBatch], schema: pa.Schema, base: int) -> Iterator[pa.RecordBatch]:
    """The top node of each subtree, and whether it is its group's root."""
    for rows in _rows(batches):
        out = []
        for r in rows:
            top = height(r["n"])
            node = levels(_hexed(r["nodes"]), min(EVERY, top - base))[-1][0]
            out.append({"g": r["g"], "n": r["n"], "position": r["block"], "leaf": bytes.fromhex(node.decode()), "root": top <= base + EVERY})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _down(batches: Iterable[pa.RecordBatch], schema: pa.Schema, base: int) -> Iterator[pa.RecordBatch]:
    """For each node of a stored level the siblings from it to the top, for the subtree below it."""
    for rows in _rows(batches):
        out = []
        for r in rows:
            tree = levels(_hexed(r["nodes"]), min(EVERY, height(r["n"]) - base))
            out += [{"g": r["g"], "block": (r["block"] << EVERY) + i, "path": siblings(tree, i) + r["path"], "subroot": r["subroot"], "root": r["root"]} for i in range(len(tree[0]))]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _leaves(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each leaf with the siblings up to the root."""
    for rows in _rows(batches):
        for r in rows:
            tree = levels(_hexed(r["nodes"]), min(EVERY, height(r["n"])))
            yield pa.RecordBatch.from_pylist([
                {"g": r["g"], "key": k, "position": (r["block"] << EVERY) + i, "leaf": tree[0][i].decode(), "other": o and o.hex(), "subroot": r["subroot"].hex(), "root": r["root"].hex(), "path": siblings(tree, i) + r["path"]}
                for i, (k, o) in enumerate(zip(r["keys"], r["others"]))
            ], schema=schema)


def _verified(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each leaf with the digest of its siblings, and the root that its other leaf, or else it, leads to."""
    for rows in _rows(batches):
        out = []
        for r in rows:
            tree, root, above = levels(_hexed(r["nodes"]), min(EVERY, height(r["n"]))), r["root"].hex().encode(), r["path"]
            above_text = b"".join(s for _, s in steps(above))
            higher: dict[bytes, bytes] = {}  # the root for a top node of this subtree
            for i, (k, o) in enumerate(zip(r["keys"], r["others"])):
                path = siblings(tree, i)
                top = folded(o.hex().encode() if o else tree[0][i], path)
                if top not in higher:
                    higher[top] = folded(top, above)
                proof = hashlib.sha256(b"".join(s for _, s in steps(path)) + above_text).hexdigest()
                out.append({"key": k, "leaf": tree[0][i].decode(), "subroot": r["subroot"].hex(), "root": root.decode(), "proof_sha256": proof, "folded_root": higher[top].decode(), "verified": higher[top] == root})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _mapped(df: DataFrame, f: Any, schema: T.StructType, *more: Any) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: f(batches, arrow, *more), schema)


def _ddl(columns: str) -> list[T.StructField]:
    return T.StructType.fromDDL(columns).fields


class Tree:
    """The trees of the groups of (g, key, leaf, other): one for each g, its leaves in order of key (nulls first), then leaf.

    `g` is a string without nulls, `leaf` 32 bytes, `other` null or 32 bytes that a proof is tried on instead of it."""

    def __init__(self, leaves: DataFrame):
        key = T.StructField("key", leaves.schema["key"].dataType)
        rows = land(leaves.select("g", "key", "leaf", "other")).withColumn("tie", F.monotonically_increasing_id())
        ordered = rows.repartitionByRange("g", "key", "leaf", "tie").sortWithinPartitions("g", "key", "leaf", "tie").drop("tie")
        placed = land(_mapped(ordered, _place, T.StructType([*_ddl("part int, own long, g string"), key, *_ddl("leaf binary, other binary")])))
        counts = placed.groupBy("g", "part").agg(F.count("*").alias("c"))
        group = Window.partitionBy("g")
        # a group has one row for each part, and parts x groups bounds no more than the groups that share parts
        starts = counts.select("g", "part", (F.sum("c").over(group.orderBy("part")) - F.col("c")).alias("start"), F.sum("c").over(group).alias("n"))
        rows = placed.join(starts, ["g", "part"]).withColumn("position", F.col("start") + F.col("own"))
        self.key, self.stored, self.roots = key, [self._stored(rows)], None
        most = starts.agg(F.max("n")).first()[0] or 0
        for base in range(0, max(1, height(most)), EVERY):
            nodes = _mapped(self.stored[-1], _up, T.StructType(_ddl("g string, n long, position long, leaf binary, root boolean")), base)
            more = height(most) > base + EVERY
            nodes = land(nodes) if more else nodes
            done = nodes.filter("root").select("g", "n", F.col("leaf").alias("subroot"))
            self.roots = done if self.roots is None else self.roots.unionByName(done)
            if more:
                self.stored.append(self._stored(nodes.filter("not root").select("g", "n", "position", F.lit(None).cast(key.dataType).alias("key"), "leaf", F.lit(None).cast("binary").alias("other"))))
        self.roots = land(self.roots)

    def _stored(self, nodes: DataFrame) -> DataFrame:
        """A stored level, one row a subtree."""
        blocks = nodes.withColumn("block", F.shiftright("position", EVERY)).repartition("g", "block").sortWithinPartitions("g", "block", "position")
        schema = T.StructType([*_ddl("g string, block long, n long"), T.StructField("keys", T.ArrayType(nodes.schema["key"].dataType)), *_ddl("nodes binary, others array<binary>")])
        return land(_mapped(blocks, _pack, schema))

    def below(self, tops: DataFrame) -> DataFrame:
        """The subtrees of level 0 with the siblings above them; tops has (g, path, root): what is above each group's root."""
        last = F.floor((F.length(F.bin(F.col("n") - 1)) - 1) / EVERY)  # the stored level of a tree's top subtree
        tops = self.roots.join(tops, "g").select("g", F.lit(0).cast("long").alias("block"), "path", "subroot", "root", last.alias("last"))
        paths = None
        for k in range(len(self.stored) - 1, -1, -1):
            own = tops.filter(F.col("last") == k).drop("last")
            paths = own if paths is None else paths.unionByName(own)
            found = self.stored[k].join(paths, ["g", "block"])
            if k:
                paths = _mapped(found, _down, T.StructType(_ddl("g string, block long, path binary, subroot binary, root binary")), k * EVERY)
        return found


class Manifest:
    """The tree of the groups' roots above the trees of the groups of (group, key, leaf, other), see Tree."""

    def __init__(self, leaves: DataFrame, group: str):
        marked = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # orders nulls first, then by UTF-8 bytes
        self.groups = Tree(leaves.select(marked.alias("g"), "key", "leaf", "other"))
        over = self.groups.roots.select(F.lit("").alias("g"), F.col("g").alias("key"), F.col("subroot").alias("leaf"), F.lit(None).cast("binary").alias("other"))
        self.over = Tree(over)
        top = self.over.roots.select("g", F.lit(b"").alias("path"), F.col("subroot").alias("root"))
        tops = _mapped(self.over.below(top), _leaves, T.StructType(_ddl("g string, key string, position long, leaf string, other string, subroot string, root string, path binary")))
        self.found = self.groups.below(tops.select(F.col("key").alias("g"), "path", F.unhex("root").alias("root")))

    def proofs(self) -> DataFrame:
        """key, leaf, other, subroot, root and `path`: the siblings from the leaf to the root with their sides (see `siblings`)."""
        columns = T.StructType([*_ddl("g string"), self.groups.key, *_ddl("position long, leaf string, other string, subroot string, root string, path binary")])
        return _mapped(self.found, _leaves, columns).drop("g")

    def verified(self) -> DataFrame:
        """key, leaf, subroot, root, SHA-256 of the siblings, the root that `other` (else the leaf) leads to, and whether it is the root."""
        columns = T.StructType([self.groups.key, *_ddl("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")])
        return _mapped(self.found, _verified, columns)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(lang, key, leaf, other) of (doc_id, source, lang, n_chars, text): `other` is the leaf after tampering with n_chars, for
    documents whose doc_id's CRC-32 is divisible by 7 (none where doc_id or n_chars is null)."""
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaf, other = (digest(["doc_id", "source", "lang", n, "text"]) for n in ("n_chars", more))
    return docs.select("lang", F.col("doc_id").alias("key"), leaf.alias("leaf"), F.when(hit, other).alias("other"))


def document_proofs(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot (of its lang), root, proof_sha256, folded_root and verified of every document.

    Any column may be null: a null lang is a group of its own, the first one, and null doc_ids come first in their group.
    Rows that repeat a doc_id are ordered by their leaf; equal rows get neighbouring places. Other columns are ignored. An
    empty table gives no rows."""
    return Manifest(document_leaves(docs), "lang").verified().withColumnRenamed("key", "doc_id")
