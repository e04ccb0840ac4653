"""Packing of tokenised documents into as few sequences as possible, by a grouping genetic algorithm.

Documents become pieces of at most ROOM tokens; a full piece is a sequence of its own. The others are dealt by a hash of
their row number to blocks of some BLOCK pieces, each a bin-packing instance of bounded size. A block evolves on several
islands, tasks of their own that start from other seeds. An individual is a partition of the pieces into bins; it is
better if it has fewer bins, then if its bins are more unequally filled (sum of squares). A child takes over whole
well-filled bins of one parent; the other parent's bins that hold one of these pieces are dissolved, so nothing is
packed twice, and so are its worst bins. Of what is displaced, a large piece and one or two others that fill a bin (nearly)
make a bin of their own; the rest goes, by falling size, to the fullest bin it fits.
After an epoch each island receives the elite of its neighbour. A block ends as soon as its best packing
meets the lower bound, or when no generation improves it for a while.

The worst bins of all blocks are then dissolved and their pieces packed again, in fewer blocks, until one block is left:
the waste of the last bins of many blocks comes together.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, land, strings

#: Tokens of a sequence, and the id behind each document.
ROOM, END = 2048, 0
#: Pieces of a block, islands of a block, epochs, individuals of an island, its generations in an epoch, and those without gain.
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS, PATIENCE = 8192, 2, 2, 6, 120, 30
#: Bins that a child takes over, and worst bins that it dissolves, at most.
TAKEN, WORST = 64, 24
#: One bin in so many is dissolved for the next level.
LEFT = 32

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = np.array([chr(c).isalnum() and c < 128 for c in range(256)])
_SIGN = np.array([33 <= c < 127 and not chr(c).isalnum() and c != 39 for c in range(256)])
_WIDE_END = np.zeros(256, bool)  # last bytes of the white space beyond ASCII
_WIDE_END[[0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]] = True


class Pieces:
    """Ids of texts by the tokenizers library, remembered up to a bound for the parts that a byte-level pre-tokenizer
    never joins: it ends a token before white space that follows something else, and between an ASCII letter or digit and
    a sign. Texts with `<|`, as special tokens have it, and all texts of other kinds of tokenizers are not cut."""

    REMEMBERED, TOGETHER = 1_000_000, 1 << 23

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.cut = (
            kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
            and all("<|" in t["content"] for t in kind.get("added_tokens") or ())
        )
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _add(self, fresh: list[bytes]) -> None:
        ids = [e.ids for e in self.library.encode_batch_fast([raw.decode("utf-8", "replace") for raw in fresh], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        self.known.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh))))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.concatenate([self.flat, *(np.array(i, np.int32) for i in ids)]) if len(ids) < 1000 else np.append(self.flat, np.fromiter((x for i in ids for x in i), np.int32))

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Borders of the parts of all texts, and how many each text has."""
        space = _SPACE[data]
        at = np.flatnonzero((space[1:] & ~space[:-1]) | (_WORD[data[:-1]] & _SIGN[data[1:]])) + 1
        last = data[at - 1]
        odd = np.flatnonzero(_WIDE_END[last] & (last >= 0x80))
        if len(odd):  # after white space beyond ASCII nothing ends; C3 begins Latin letters only
            odd = odd[data[at[odd] - 2] != 0xC3]
            at = np.delete(at, odd)
        border = np.zeros(len(data) + 1, bool)
        border[at] = border[offsets] = True
        borders = np.flatnonzero(border)
        return borders, np.diff(np.searchsorted(borders, offsets))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For parts of the texts: the ids of their texts one after another, END behind each, and how many each has with it."""
        special = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)
        if not self.cut:
            special[:] = True
        borders = [0, *(np.flatnonzero(special[1:] != special[:-1]) + 1).tolist(), len(special)]
        for x, y in zip(borders[:-1], borders[1:]):
            data, offsets = strings(texts.slice(x, y - x))
            for _, _, part, off in byte_chunks(data, offsets, self.TOGETHER):
                edges, count = (np.unique(off), (np.diff(off) > 0).astype(np.int64)) if special[x] else self._parts(part, off)
                if len(edges) < 2:
                    yield np.full(len(count), END, np.int32), np.ones(len(count), np.int64)
                    continue
                runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(part))])
                coded = runs.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                fresh = [r for r in distinct if r not in self.known]
                if len(self.known) + len(fresh) > self.REMEMBERED:
                    self._clear()
                    fresh = distinct
                if fresh:
                    self._add(fresh)
                index = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct)).take(coded.indices.to_numpy())
                size = self.size.take(index)
                ends = np.append(0, np.cumsum(size))
                flat = self.flat.take(np.arange(ends[-1]) + np.repeat(self.start.take(index) - ends[:-1], size))
                text_ends = ends[np.cumsum(count)]
                yield np.insert(flat, text_ends, END), np.diff(text_ends, prepend=0) + 1


_coders: dict[str, Pieces] = {}


def _tokenised(batches: Iterable[pa.RecordBatch], path: str, room: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text): the pieces of each document, numbered in this partition."""
    coder = _coders.get(path) or _coders.setdefault(path, Pieces(path))
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        docs, a = batch.column("doc_id"), 0
        for flat, count in coder.encode(batch.column("text")):
            flat = np.ascontiguousarray(flat, "<u4")
            # a longer document is cut from its end, so that only the first piece may be shorter
            pieces = np.maximum(1, -(-count // room))
            which = np.repeat(np.arange(len(count)), pieces)
            place = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            end = count[which] - (pieces[which] - 1 - place) * room
            start = np.maximum(0, end - room)
            first = (np.cumsum(count) - count)[which]
            cut = list(zip((first + start).tolist(), (first + end).tolist()))
            out = {
                "rid": pa.array(number + np.arange(len(which))), "doc_id": docs.take(pa.array(a + which)), "piece": pa.array(place, pa.int32()),
                "start": pa.array(start), "length": pa.array(end - start), "ids_crc32": pa.array([zlib.crc32(flat[x:y]) for x, y in cut], pa.int64()),
            }
            if keep:
                out["ids"] = pa.array([flat[x:y].astype(np.int32) for x, y in cut], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)
            number += len(which)
            a += len(count)


def tokenised(docs: DataFrame, tokenizer: str, room: int = ROOM, ids: bool = False) -> DataFrame:
    """(rid, doc_id, piece, start, length, ids_crc32) of the pieces of (doc_id, text), with `ids` if wanted. A null text is empty."""
    columns = f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(lambda it: _tokenised(it, tokenizer, room, ids), columns + (", ids array<int>" if ids else ""))


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """Bins that any packing needs: over all t, pieces above room - t are alone with what is at least t, and those above
    half need a bin each, whose rest takes smaller ones of at least t."""
    n = np.bincount(lengths, minlength=room + 1)[: room + 1]
    many, total = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * np.arange(room + 1)))  # of lengths below k
    best = -(-int(total[-1]) // room)
    half = room // 2
    t = np.arange(half + 1)
    alone = many[-1] - many[room - t + 1]
    large, large_sum = many[room - t + 1] - many[half + 1], total[room - t + 1] - total[half + 1]
    small_sum = total[half + 1] - total[t]
    more = np.maximum(0, -(-(small_sum - (large * room - large_sum)) // room))
    return max(best, int((alone + large + more).max()))


def best_fit(order: Iterable[int], lengths: list[int], room: int, bins: np.ndarray, fills: list[int]) -> None:
    """Put pieces, in this order, each into the fullest bin that has room, else a new one; bins and fills change in place."""
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0  # the rooms that some bin has
    for b, f in enumerate(fills):
        by_room[room - f].append(b)
        mask |= 1 << (room - f)
    for i in order:
        s = lengths[i]
        fit = mask >> s
        if fit:
            r = s + (fit & -fit).bit_length() - 1
            here = by_room[r]
            b = here.pop()
            if not here:
                mask ^= 1 << r
            fills[b] += s
            r -= s
        else:
            b, r = len(fills), room - s
            fills.append(s)
        bins[i] = b
        by_room[r].append(b)
        mask |= 1 << r


class Island:
    """A population of packings of the same pieces; each is (bins of the pieces, fills of the bins), the best first."""

    def __init__(self, lengths: np.ndarray, room: int, seed: list[int], guests: Iterable[np.ndarray] = ()):
        self.lengths, self.list, self.room, self.rng = lengths, lengths.tolist(), room, np.random.default_rng(seed)
        self.bound = lower_bound(lengths, room)
        self.members = [(np.asarray(g), np.bincount(g, lengths).astype(np.int64)) for g in guests]
        n = len(lengths)
        while len(self.members) < POPULATION and not self.optimal():
            # by falling size, exactly and a little out of order; then with whole bins first
            k, bins, fills, rest = len(self.members), np.full(n, -1, np.int32), [], np.arange(n)
            if k == 1:
                rest = self._whole_bins(bins, fills, rest, room // 256 * (seed[-1] % 2))
            self.members.append(self._filled(bins, fills, rest[np.argsort(-(lengths[rest] + self.rng.random(len(rest)) * (room / 16 if k > 1 else 0)), kind="stable")]))
        self._rank()

    def _filled(self, bins: np.ndarray, fills: list[int], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best_fit(order.tolist(), self.list, self.room, bins, fills)
        return bins, np.array(fills, np.int64)

    @staticmethod
    def quality(member: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
        return -len(member[1]), int((member[1] ** 2).sum())

    def _rank(self) -> None:
        self.members.sort(key=self.quality, reverse=True)
        del self.members[POPULATION:]

    def optimal(self) -> bool:
        return any(len(m[1]) <= self.bound for m in self.members)

    def child(self, host: tuple[np.ndarray, np.ndarray], donor: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        bins, fills = host
        good = np.flatnonzero(donor[1] >= np.median(donor[1]))
        taken = np.zeros(len(donor[1]), bool)
        taken[self.rng.choice(good, int(self.rng.integers(1, 2 + min(TAKEN, len(good) // 8))), replace=False)] = True
        injected = taken[donor[0]]
        gone = np.zeros(len(fills), bool)
        gone[bins[injected]] = True
        gone[np.argsort(fills)[: 1 + int(self.rng.integers(0, 1 + min(WORST, len(fills) // 8)))]] = True
        displaced = np.flatnonzero(gone[bins] & ~injected)
        number = np.cumsum(~gone) - 1
        out = np.where(injected, (len(fills) - gone.sum()) + (np.cumsum(taken) - 1)[donor[0]], number[bins]).astype(np.int32)
        after = [*fills[~gone].tolist(), *donor[1][taken].tolist()]
        rest = self._whole_bins(out, after, displaced, int(self.room * self.rng.choice([0, 0, 1 / 256, 1 / 64])))
        blur = self.rng.random(len(rest)) * (self.room / 64)
        return self._filled(out, after, rest[np.argsort(-(self.lengths[rest] + blur))])

    def _whole_bins(self, bins: np.ndarray, fills: list[int], displaced: np.ndarray, slack: int) -> np.ndarray:
        """New bins of two or three displaced pieces that leave `slack` at most; returns the other pieces."""
        order = displaced[np.argsort(self.lengths[displaced] + self.rng.random(len(displaced)) * 0.5)]
        size, rest = self.lengths[order], []
        while len(order) > 1:
            room, large = self.room - size[-1], order[-1]
            order, size = order[:-1], size[:-1]
            # for each piece the largest one before it that fits beside it, or none
            other = np.minimum(np.searchsorted(size, room - size, "right") - 1, np.arange(len(size)) - 1)
            both = np.where(size > room, -1, size + np.where(other >= 0, size[other], 0))
            i = int(both.argmax())
            if both[i] < max(1, room - slack):
                rest.append(large)
                continue
            chosen = [i, int(other[i])] if other[i] >= 0 else [i]
            bins[[large, *order[chosen]]] = len(fills)
            fills.append(self.room - int(room - both[i]))
            order, size = np.delete(order, chosen), np.delete(size, chosen)
        return np.append(np.array(rest, np.int64), order)

    def evolve(self) -> None:
        idle = 0
        for _ in range(GENERATIONS):
            if self.optimal() or idle >= PATIENCE or len(self.members) < 2:
                return
            best = self.quality(self.members[0])
            for _ in range(POPULATION // 2):
                pick = np.sort(self.rng.choice(len(self.members), (2, 2)), 1)[:, 0]  # of two drawn members the better one
                self.members.append(self.child(self.members[pick[0]], self.members[pick[1]]))
            self._rank()
            idle = 0 if self.quality(self.members[0]) > best else idle + 1


_STATE = "block long, island int, rids array<long>, lengths array<int>, elites array<array<int>>, bins int, score long, done boolean"


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of (block, rid, length) sorted by block."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "block": pa.array([held[0][0]]), "rids": pa.array([np.concatenate([h[1] for h in held])], pa.list_(pa.int64())), "lengths": pa.array([np.concatenate([h[2] for h in held])], pa.list_(pa.int32())),
        })

    for batch in batches:
        if not batch.num_rows:
            continue
        block, rid, length = (batch.column(k).to_numpy() for k in ("block", "rid", "length"))
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0][0] != block[a]:
                yield out()
                held = []
            held.append((int(block[a]), rid[a:b], length[a:b].astype(np.int32)))
    if held:
        yield out()


def _evolved(batches: Iterable[pa.RecordBatch], room: int, epoch: int, level: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k).slice(i, 1) for k in ("block", "island", "rids", "lengths")}
            lengths = row["lengths"].values.to_numpy()[row["lengths"].offsets[0].as_py() : row["lengths"].offsets[1].as_py()].astype(np.int64)
            guests = [np.array(g, np.int32) for g in batch.column("guests")[i].as_py() or ()]
            island = Island(lengths, room, [level, epoch, row["block"][0].as_py(), row["island"][0].as_py()], guests)
            island.evolve()
            best = island.quality(island.members[0])
            elites = [m[0] for m in island.members[:2]]
            yield pa.RecordBatch.from_pydict(row | {"elites": pa.array([elites], pa.list_(pa.list_(pa.int32()))), "bins": pa.array([-best[0]], pa.int32()), "score": pa.array([best[1]], pa.int64()), "done": pa.array([island.optimal()])})


def _placed(batches: Iterable[pa.RecordBatch], level: int, last: bool) -> Iterator[pa.RecordBatch]:
    """The pieces of each block with their sequence and offset; those of the worst bins have none unless this is the last level."""
    for batch in batches:
        for i in range(batch.num_rows):
            block = batch.column("block")[i].as_py()
            rids, lengths, bins = (batch.column(k)[i].values.to_numpy() for k in ("rids", "lengths", "elite"))
            fills = np.bincount(bins, lengths)
            gone = np.zeros(len(fills), bool)
            if not last:
                gone[np.argsort(fills, kind="stable")[: max(1, len(fills) // LEFT)]] = True
            order = np.lexsort((rids, bins))
            ends = np.cumsum(lengths[order], dtype=np.int64)
            new = np.flatnonzero(np.diff(bins[order], prepend=-1))
            before = np.repeat(np.append(0, ends)[new], np.diff(new, append=len(order)))
            out = gone[bins[order]]
            yield pa.RecordBatch.from_pydict({
                "rid": pa.array(rids[order]), "length": pa.array(lengths[order].astype(np.int64)),
                "sequence_id": pa.array((level << 56) + (block << 24) + bins[order].astype(np.int64), pa.int64(), mask=out), "offset": pa.array(ends - lengths[order] - before, pa.int64(), mask=out),
            })


def _sequences(items: DataFrame, count: int, room: int, level: int) -> DataFrame:
    """(rid, length, sequence_id, offset) of one level's pieces (rid, length); sequence_id is null for what the next level packs."""
    blocks = -(-count // BLOCK)
    tasks = min(blocks * ISLANDS, 20_000)  # rows are few and costly: without a number, adaptive execution would join them
    block = F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(blocks)).alias("block")
    gathered = items.select(block, "rid", F.col("length").cast("int").alias("length")).repartition(min(blocks, 20_000), "block").sortWithinPartitions("block", "rid")
    instances = gathered.mapInArrow(_gathered, "block long, rids array<long>, lengths array<int>")
    start = instances.select("*", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.lit(None).cast("array<array<int>>").alias("guests"))
    state = land(start.repartition(tasks, "block", "island").mapInArrow(lambda it: _evolved(it, room, 0, level), _STATE))
    for epoch in range(1, EPOCHS):
        open_ = state.join(state.filter("done").select("block").distinct(), "block", "left_anti")
        if open_.isEmpty():
            break
        to = F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island")
        sent = open_.select("block", to, F.col("elites").alias("sent"))
        met = open_.join(sent, ["block", "island"]).select("block", "island", "rids", "lengths", F.concat("elites", "sent").alias("guests"))
        after = met.repartition(tasks, "block", "island").mapInArrow(lambda it, epoch=epoch: _evolved(it, room, epoch, level), _STATE)
        state = land(state.join(open_.select("block").distinct(), "block", "left_anti").select(*state.columns).unionByName(after))
    best = state.groupBy("block").agg(F.max_by(F.struct("rids", "lengths", F.col("elites")[0].alias("elite")), F.struct(-F.col("bins"), "score", -F.col("island"))).alias("b")).select("block", "b.*")
    placed = best.repartition(tasks, "block").mapInArrow(lambda it: _placed(it, level, blocks == 1), "rid long, length long, sequence_id long, offset long")
    return land(placed)


def sequences(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """(rid, sequence_id, offset) for landed pieces (rid, length of 1 to room): no sequence holds more than room tokens."""
    full = F.col("length") == room
    out = pieces.filter(full).select("rid", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items, level = pieces.filter(~full).select("rid", "length"), 0
    while count := items.count():
        placed = _sequences(items, count, room, level)
        out = out.unionByName(placed.filter("sequence_id is not null").select("rid", "sequence_id", "offset"))
        if count <= BLOCK:
            break
        items, level = placed.filter("sequence_id is null").select("rid", "length"), level + 1
    return out


def packed(docs: DataFrame, tokenizer: str, room: int = ROOM, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if wanted) of the pieces of (doc_id, text).

    A document is its ids and END; a longer one than `room` is cut from its end. A null text is empty. Rows that repeat a
    doc_id are documents of their own; other columns are ignored; an empty table gives no rows. The token ids are computed
    once; pieces land in the shared scratch folder, with their ids only if these are wanted."""
    pieces = land(tokenised(docs, tokenizer, room, ids))
    return pieces.join(sequences(pieces, room), "rid").drop("rid")


def token_sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that have their ids: a sequence has `room` of them at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
