"""Token ids in a compact binary form: an adaptive context-mixing range coder over independent blocks.

A segment holds the ids of a run of documents, cut into blocks. Every block starts from a fresh model and carries a
CRC-32 of its ids, so any block can be decoded and checked alone. A block's ids lie in streams of equal length that
advance together, one id of each at a time, as lanes of numpy arrays; the streams share the block's model.

The model is built again from all ids of the block so far at fixed steps, and stands still in between. It holds

* order 2: for each pair of ids before, the ids that followed most often,
* order 1: the same for the one id before,
* order 0: the distribution of the ids that these lists lacked when they came, with an escape to ids of two bytes.

An id is coded by one interval of a list that mixes order 2 and order 1 (an id that both propose gets the sum), or by
what the list leaves, within which order 0 codes it. The weights of the mixture follow, for each block and each
confidence (how often a context was seen), what either order has contributed to the ids coded so far. Chances and
bounds are integers, so the decoder builds the same model from the ids it has decoded.

A segment as bytes: magic, little-endian counts (ids, blocks, streams, steps), a CRC-32 for each block, a number of
32-bit words for each stream, then the words.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_chunks, land, strings

MAGIC = b"IDS3"
#: Streams of a block at most and ids of a stream; ids that a segment holds about (a longer document makes a longer one).
STREAMS, STEPS, SEGMENT = 512, 1024, 1 << 23
#: Steps after which the model is built again.
BUILDS = (4, 16, 64, 192, 384, 640)
#: The end id appended to each document.
END = 1
_H1, _H2 = 13, 16  # bits of the hashed contexts of order 1 and order 2 of a block
_OWN, _LOW = 2, 3  # ids that an order-2 context proposes, and that its order-1 context does
_LIST = _OWN + _LOW
_FULL, _ZERO = 1 << 16, 14  # scale of a list's chances, and bits of the scale of order 0
_NONE = 65535  # no id
_BUCKETS, _EMPTY = 8, 15  # confidences of an order; the mark of the empty list
_AT_ONCE = 32  # steps whose intervals are computed together
_M32 = np.uint64(0xFFFFFFFF)
_EACH = np.uint64(0x0001000100010001)  # spreads 16 bits to all four places of 64
_U14, _U16, _U32 = np.uint64(_ZERO), np.uint64(16), np.uint64(32)
_BUCKET = np.minimum(np.array([0] + [v.bit_length() - 1 for v in range(1, 1 << 12)]), _BUCKETS - 1)


def _slots(p1: np.ndarray, p2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed contexts of order 1 and order 2."""
    spread = p1 * 40503
    return (spread >> 5) & ((1 << _H1) - 1), ((spread + p2 * 210077) >> 4) & ((1 << _H2) - 1)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts; sorts key in place."""
    key.sort()
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return key[first], np.diff(first, append=len(key))


def _best(key: np.ndarray, most: int, least: int) -> tuple[np.ndarray, ...]:
    """From keys (context << 16 | id): the contexts seen `least` times, how often, and their `most` commonest ids with counts.

    Sorts key in place. Ids and counts have a row for each place, so that what is computed from them runs along contexts."""
    key.sort()
    new = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    first = np.flatnonzero(new)
    key = key.take(first[:-1])
    ctx = key >> 16
    new = np.ones(len(key), bool)
    np.not_equal(ctx[1:], ctx[:-1], out=new[1:])
    start = np.flatnonzero(new)
    total = np.diff(first.take(start), append=first[-1])
    keep = np.flatnonzero(total >= least)
    rank = (np.minimum(np.diff(first), 65535).astype(np.uint32) << 16) | (~key & 65535)  # the commonest id, then the smallest
    ids, n = np.empty((most, len(keep)), np.uint32), np.empty((most, len(keep)), np.uint32)
    for j in range(most):
        if j:  # the best so far are out
            rank *= rank != np.repeat(top, np.diff(start, append=len(rank)))
        top = np.maximum.reduceat(rank, start)
        best = top.take(keep)
        ids[j], n[j] = ~best & 65535, best >> 16
    return ctx.take(start.take(keep)), total.take(keep), ids, n


def _with_zero(chance: np.ndarray, ids: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Chances of a list's ids with what order 0 (of the whole block) gives them of the rest; ids that are not listed keep none."""
    rest = 65000 - np.minimum(chance.sum(axis=0, dtype=np.uint32), 65000)
    return chance + rest * zero.take(ids) // 65000 * (chance > 0)


class Model:
    """The models of all blocks of a segment that are still active: the last block may be shorter and leave early."""

    def __init__(self, blocks: int, streams: int):
        self.blocks, self.streams = blocks, streams
        self.list1, self.list2 = np.zeros(blocks << _H1, np.int32), np.zeros(blocks << _H2, np.int32)
        self.block = np.arange(blocks * streams, dtype=np.int32) // streams
        self.base1, self.base2, self.base0 = (self.block.astype(np.uint32) << bits for bits in (_H1, _H2, _ZERO))
        self._lists([], [], [], [])
        # for each block and confidence (of order 2, then of order 1 alone): ids coded, shares that the context's own
        # ids and those of the order below had in them; with a start
        self.seen = np.full(blocks * 16, 32.0)
        self.won = np.tile(np.append(np.linspace(12, 28, _BUCKETS), np.linspace(8, 24, _BUCKETS)), blocks)
        self.lent = np.tile(np.append(np.linspace(6, 1, _BUCKETS), np.zeros(_BUCKETS)), blocks)
        self.lacked, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)  # block << 16 | id, and how often
        self.fresh, self.missed = np.ones(blocks, np.int64), np.ones(blocks, np.int64)
        self.gone: list[np.ndarray] = []
        self.built, self.often = 0, np.zeros((blocks, 1 << 16), np.int64)  # steps of the last build, and how often each id came
        self._order_zero()

    def shrink(self) -> None:
        """The last block leaves."""
        self.blocks = n = self.blocks - 1
        self.list1, self.list2 = self.list1[: n << _H1], self.list2[: n << _H2]
        for name in ("block", "base0", "base1", "base2"):
            setattr(self, name, getattr(self, name)[: n * self.streams])
        for name in ("seen", "won", "lent"):
            setattr(self, name, getattr(self, name)[: n * 16])
        keep = (self.lacked >> 16) < n
        self.lacked, self.times, self.fresh, self.missed = self.lacked[keep], self.times[keep], self.fresh[:n], self.missed[:n]
        self.often = self.often[:n]

    def _order_zero(self) -> None:
        """Slots for the ids that lists lacked (half of all slots at most: later ones escape), the rest for escapes."""
        full = 1 << _ZERO
        block = self.lacked >> 16
        kinds = np.bincount(block, minlength=self.blocks)
        rank = np.arange(len(block)) - np.repeat(np.cumsum(kinds) - kinds, kinds)
        keep = rank < full // 2
        key, n, block = self.lacked[keep], self.times[keep], block[keep]
        kinds = np.minimum(kinds, full // 2)
        sums = np.bincount(block, n, self.blocks).astype(np.int64)
        escape = np.where(kinds == 0, full, np.clip(full * (self.fresh + 1) // (self.missed + 2), 16, full // 4))
        width = 1 + n * (full - escape - kinds).clip(0)[block] // np.maximum(sums[block], 1)
        self.zero_end = np.bincount(block, width, self.blocks).astype(np.int64)
        at = np.cumsum(width) - width - (np.cumsum(self.zero_end) - self.zero_end)[block]
        known = np.repeat(np.tile([True, False], self.blocks), np.stack([self.zero_end, full - self.zero_end], axis=1).ravel())
        self.zero_kinds, rest = len(key), np.arange(len(key), len(key) + self.blocks, dtype=np.int32)  # the escape of each block comes last
        self.zero_slot = np.repeat(rest, full)
        self.zero_slot[known] = np.repeat(np.arange(len(key), dtype=np.int32), width)
        self.zero_of = np.repeat(rest, 1 << 16)
        self.zero_of[key] = np.arange(len(key), dtype=np.int32)
        self.zero_id = np.append(key & 65535, np.full(self.blocks, _NONE)).astype(np.uint32)
        self.zero_at = np.append(at, self.zero_end).astype(np.uint64)
        self.zero_width = np.append(width, full - self.zero_end).astype(np.uint64)

    def rows(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """The list for each pair of ids before: of order 2, of order 1 where that is unknown, or the empty one."""
        s1, s2 = _slots(p1, p2)
        s2 += self.base2
        row = self.list2.take(s2)
        s1 += self.base1
        return np.where(row == 0, self.list1.take(s1), row)

    def note(self, ids: np.ndarray, row: np.ndarray, k: np.ndarray, block: np.ndarray) -> None:
        """Of ids just coded with place k of a list: what each order had in them, and what the lists lacked."""
        mark, n = self.mark.take(row), self.blocks * 16
        at = mark + (block << 4)
        self.seen += np.bincount(at, minlength=n)
        hits = np.bincount(at[k < _LIST], minlength=n)
        both = np.flatnonzero((k < _OWN) & (mark < _BUCKETS))
        r, place = row.take(both), k.take(both)
        f = self.flat.take(r * 16 + place + 1).astype(np.int32) - self.flat.take(r * 16 + place)
        share = np.bincount(at.take(both), np.minimum(self.own.take(r * _OWN + place).astype(np.int32) * 256 // f, 256), n) / 256
        alone = np.arange(n) % 16 >= _BUCKETS
        self.won += np.where(alone, hits, share)
        self.lent += np.where(alone, 0, hits - share)
        gone = np.flatnonzero(k == _LIST)
        self.gone.append((block[gone].astype(np.int64) << 16) | ids[gone])

    def build(self, past: np.ndarray) -> None:
        """Order 0 and the lists of all contexts from past: two steps of zeros and the steps so far, of all lanes."""
        found, n = _counted(np.concatenate(self.gone))
        self.gone = []
        before = np.bincount(self.lacked >> 16, minlength=self.blocks)
        self.missed = np.bincount(found >> 16, n, self.blocks).astype(np.int64)
        key, times = np.concatenate([self.lacked, found]), np.concatenate([self.times, n])
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        self.lacked, self.times = key[start], np.add.reduceat(times, start) if len(start) else times
        self.fresh = np.bincount(self.lacked >> 16, minlength=self.blocks) - before
        self._order_zero()

        won, lent = ((x / (self.seen + 1) * 4096).astype(np.uint32) for x in (self.won, self.lent))
        self.list1[:], self.list2[:] = 0, 0
        chances, ids_, owns, marks, count = [], [], [], [], 1
        for g in range(self.blocks):
            h = past[:, g * self.streams : (g + 1) * self.streams]
            s1, s2 = _slots(h[1:-1], h[:-2])
            self.often[g] += np.bincount(h[2 + self.built :].ravel(), minlength=1 << 16)
            zero = (self.often[g] * 65000 // s1.size).astype(np.uint32)
            ctx, n, low_id, times = _best(((s1 << 16) | h[2:]).ravel(), _LOW, 1)
            sure = _BUCKET.take(np.minimum(n, len(_BUCKET) - 1))
            low = (times * 65000.0 / n).astype(np.uint32)
            first, nothing = count, np.zeros((_OWN, len(ctx)), np.uint32)
            alone = low * won.take(g * 16 + sure + _BUCKETS) >> 12
            chances.append(np.append(nothing, _with_zero(alone, low_id, zero), axis=0))
            ids_.append(np.append(nothing + _NONE, low_id, axis=0))
            owns.append(nothing)
            marks.append(np.minimum(sure + _BUCKETS, _EMPTY - 1))
            self.list1[(g << _H1) + ctx.astype(np.int64)] = np.arange(count, count + len(ctx))
            count += len(ctx)
            below = np.zeros(1 << _H2, np.uint16)
            below[s2] = s1
            ctx, n, own_id, times = _best(((s2 << 16) | h[2:]).ravel(), _OWN, 2)
            sure = _BUCKET.take(np.minimum(n, len(_BUCKET) - 1))
            own = (times * 65000.0 / n).astype(np.uint32) * won.take(g * 16 + sure) >> 12
            at = self.list1.take((g << _H1) + below.take(ctx).astype(np.int64)) - first
            other_id, other = low_id.take(at, axis=1), low.take(at, axis=1) * lent.take(g * 16 + sure) >> 12
            both = own.copy()
            for i in range(_OWN):
                same = (other_id == own_id[i]) & (other_id != _NONE)
                both[i] += (other * same).sum(axis=0, dtype=np.uint32)
                other *= ~same
            every = np.append(own_id, other_id, axis=0)
            chances.append(_with_zero(np.append(both, other, axis=0), every, zero))
            ids_.append(every)
            owns.append(own)
            marks.append(sure)
            self.list2[(g << _H2) + ctx.astype(np.int64)] = np.arange(count, count + len(ctx))
            count += len(ctx)
        self.built = len(past) - 2
        self._lists(chances, ids_, owns, marks)

    def _lists(self, chances: list, ids: list, owns: list, marks: list) -> None:
        """The empty list, then all others. A row is eight bounds, then eight ids, of 16 bits, unused ones at the end: half a cache line."""
        rows = 1 + sum(map(len, marks))
        table = np.full((rows, 16), _NONE, np.uint16)
        self.own, self.mark = np.zeros((rows, _OWN), np.uint16), np.full(rows, _EMPTY, np.uint8)
        table[:, 0], table[0, : _LIST + 1] = 0, 0
        at = 1
        for f, i, own, mark in zip(chances, ids, owns, marks):
            end, i[f == 0] = at + len(mark), _NONE
            table[at:end, 1 : _LIST + 1] = np.cumsum(f, axis=0, dtype=np.uint32).T
            table[at:end, 8 : 8 + _LIST] = i.T
            self.own[at:end], self.mark[at:end] = own.T, mark
            at = end
        self.own, self.flat, self.eights = self.own.ravel(), table.ravel(), table.view(np.complex128).ravel()

    def beside(self, half: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Eight bounds or ids of each list (its row twice, and 1 for ids), and eight times the value below 65,536 to compare them with."""
        wide = np.empty((len(half), 2), np.uint64)
        wide[:, 0] = value
        wide[:, 0] *= _EACH
        wide[:, 1] = wide[:, 0]
        return self.eights.take(half).view(np.uint16), wide.view(np.uint16).ravel()


def _narrow(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lanes whose span is below 2**32, moved on by a word, and their low before; a span that straddles a word border is cut at it."""
    lanes = np.flatnonzero(span <= _M32)
    top = low.take(lanes)
    if len(lanes):
        span[lanes] = np.minimum(span.take(lanes), (_M32 + np.uint64(1)) - (top & _M32)) << _U32
        low[lanes] = top << _U32
    return lanes, top


def _layout(n: int) -> tuple[int, int, int]:
    """Blocks, streams of a block, and steps of the last block. Few ids make fewer streams."""
    streams = min(STREAMS, max(16, -(-n // STEPS)))
    blocks = -(-n // (streams * STEPS))
    return blocks, streams, -(-(n - (blocks - 1) * streams * STEPS) // streams)


def _steps(steps: int, lanes: int) -> np.ndarray:
    """Room for the ids of all lanes, a row a step, after two rows of zeros. Rows are padded: at a power of two they would share cache lines."""
    return np.zeros((steps + 2, lanes + 16), np.uint32)


def encode(ids: np.ndarray) -> bytes:
    """A segment of ids below 65,535."""
    if len(ids) and int(ids.max()) >= _NONE:
        raise ValueError("ids must be below 65,535")
    if not len(ids):
        return MAGIC + struct.pack("<QIII", 0, 0, 0, 0)
    blocks, streams, tail = _layout(len(ids))
    whole, size = blocks, streams * STEPS
    model, lanes = Model(blocks, streams), blocks * streams
    rest = np.full(tail * streams, END, np.uint32)
    rest[: len(ids) - (blocks - 1) * size] = ids[(blocks - 1) * size :]
    past = _steps(STEPS, lanes)
    past[2:, : lanes - streams] = ids[: (blocks - 1) * size].reshape(-1, STEPS).T
    past[2 : tail + 2, lanes - streams : lanes] = rest.reshape(streams, tail).T
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    width = STEPS * 3 // 2 + 8
    words, fill = np.zeros(lanes * width, np.uint32), np.arange(lanes) * width

    def put() -> None:
        at, top = _narrow(low, span)
        if len(at):
            place = fill.take(at)
            words[place] = top >> _U32
            fill[at] = place + 1

    def flush(a: int, b: int) -> None:
        at = fill[a:b]
        words[at], words[at + 1] = low[a:b] >> _U32, low[a:b] & _M32
        fill[a:b] += 2

    a = 0
    for b in sorted({*BUILDS, tail, STEPS, *range(0, STEPS, _AT_ONCE)} - {0}):
        row = model.rows(past[a + 1 : b + 1, :lanes], past[a:b, :lanes]).ravel()
        now = past[a + 2 : b + 2, :lanes].ravel()
        own, value = model.beside(row * 2 + 1, now)
        k = np.minimum(np.bitwise_count((own == value).view(np.uint64) - np.uint64(1)) >> 3, _LIST)  # the place of the one true byte
        at = row * 16 + k
        begin = model.flat.take(at).astype(np.uint64)
        lacks = k == _LIST
        freq = np.where(lacks, _FULL, model.flat.take(at + 1).astype(np.int32)).astype(np.uint64) - begin
        gone = np.flatnonzero(lacks)
        step, lane = np.divmod(gone, lanes)
        block = model.block.take(lane)
        z = model.zero_of.take((block << 16) | now[gone])
        begin0, freq0 = model.zero_at.take(z), model.zero_width.take(z)
        new = np.flatnonzero(z >= model.zero_kinds)
        every = np.arange(b - a + 1)
        ends, ends_new = np.searchsorted(step, every).tolist(), np.searchsorted(step[new], every).tolist()
        lane_new, value_new = lane[new], now[gone[new]].astype(np.uint64)
        begin, freq = begin.reshape(-1, lanes), freq.reshape(-1, lanes)
        for t in range(b - a):
            part = span >> _U16
            low += part * begin[t]
            np.multiply(part, freq[t], out=span)
            x, y = ends[t], ends[t + 1]
            if x < y:
                ln = lane[x:y]
                part = span.take(ln) >> _U14
                low[ln] = low.take(ln) + part * begin0[x:y]
                span[ln] = part * freq0[x:y]
            put()
            x, y = ends_new[t], ends_new[t + 1]
            if x < y:
                part = span[lane_new[x:y]] >> _U16
                low[lane_new[x:y]] += part * value_new[x:y]
                span[lane_new[x:y]] = part
                put()
        if b <= BUILDS[-1]:  # a build is still to come
            model.note(now, row, k, np.tile(model.block, b - a))
        a = b
        if b == tail and b < STEPS:
            flush((model.blocks - 1) * streams, lanes)
            if model.blocks == 1:
                break
            _leave(model)
            lanes = model.blocks * streams
            low, span = low[:lanes].copy(), span[:lanes].copy()
        if b in BUILDS:
            model.build(past[: b + 2, :lanes])
    else:
        flush(0, lanes)
    rows, fill = words.reshape(-1, width), fill - np.arange(len(fill)) * width
    out = np.concatenate([w[:n] for w, n in zip(rows, fill.tolist())])
    plain = ids.astype("<u4", copy=False)
    crc = np.array([zlib.crc32(plain[i : i + size]) for i in range(0, len(ids), size)], dtype="<u4")
    return MAGIC + struct.pack("<QIII", len(ids), whole, streams, STEPS) + crc.tobytes() + fill.astype("<u2").tobytes() + out.astype("<u4").tobytes()


def _leave(model: Model) -> None:
    """The last block leaves, with what it lacked since the last build."""
    model.shrink()
    model.gone = [g[(g >> 16) < model.blocks] for g in model.gone]


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; ValueError if it is cut or a block is damaged."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment of ids")
    total, blocks, streams, steps = struct.unpack_from("<QIII", segment, 4)
    if not blocks:
        return np.zeros(0, dtype=np.uint32)
    whole, lanes, size = blocks, blocks * streams, streams * steps
    head = 24 + 4 * blocks
    crc, fill = np.frombuffer(segment, "<u4", blocks, 24), np.frombuffer(segment, "<u2", lanes, head).astype(np.int64)
    if len(segment) != head + 2 * lanes + 4 * fill.sum():
        raise ValueError("the segment is cut")
    flat = np.append(np.frombuffer(segment, "<u4", -1, head + 2 * lanes), np.zeros(2, np.uint32)).astype(np.uint64)
    at, last = np.cumsum(fill) - fill, len(flat) - 1
    tail = -(-(total - (blocks - 1) * size) // streams)
    model = Model(blocks, streams)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = (flat[at] << _U32) | flat[at + 1]
    at = at + 2
    past = _steps(steps, lanes)

    def take() -> None:
        ln, _ = _narrow(low, span)
        if len(ln):
            word = at.take(ln)
            code[ln] = (code.take(ln) << _U32) | flat.take(np.minimum(word, last))  # a damaged stream may ask for more
            at[ln] = word + 1

    a = 0
    for b in sorted({*BUILDS, tail, steps, *range(0, steps, _AT_ONCE)} - {0}):
        rows, places = np.zeros((b - a, lanes), np.int32), np.zeros((b - a, lanes), np.uint8)
        for t in range(b - a):
            row = model.rows(past[a + t + 1, :lanes], past[a + t, :lanes])
            part = span >> _U16
            bounds, x = model.beside(row * 2, np.minimum((code - low) // part, np.uint64(_NONE - 1)))
            k = np.bitwise_count((bounds <= x).view(np.uint64)) - np.uint8(1)
            i = row * 16 + k
            begin = model.flat.take(i).astype(np.uint64)
            end = model.flat.take(i + 1).astype(np.uint64)
            ln = np.flatnonzero(k == _LIST)
            end[ln] = _FULL
            low += part * begin
            np.multiply(part, end - begin, out=span)
            ids = past[a + t + 2, :lanes]
            ids[:] = model.flat.take(i + 8)
            escaped = ln[:0]
            if len(ln):
                part, base = span.take(ln) >> _U14, low.take(ln)
                x = np.minimum((code.take(ln) - base) // part, np.uint64((1 << _ZERO) - 1)).astype(np.int64)
                z = model.zero_slot.take(model.base0.take(ln) + x)
                low[ln] = base + part * model.zero_at.take(z)
                span[ln] = part * model.zero_width.take(z)
                ids[ln] = model.zero_id.take(z)
                escaped = ln[z >= model.zero_kinds]
            take()
            if len(escaped):
                part = span[escaped] >> _U16
                x = np.minimum((code[escaped] - low[escaped]) // part, np.uint64(_NONE))
                low[escaped] += part * x
                span[escaped] = part
                ids[escaped] = x
                take()
            if b <= BUILDS[-1]:
                rows[t], places[t] = row, k
        if b <= BUILDS[-1]:
            model.note(past[a + 2 : b + 2, :lanes].ravel(), rows.ravel(), places.ravel(), np.tile(model.block, b - a))
        a = b
        if b == tail and b < steps:
            if model.blocks == 1:
                break
            _leave(model)
            lanes = model.blocks * streams
            low, span, code, at = (v[:lanes].copy() for v in (low, span, code, at))
        if b in BUILDS:
            model.build(past[: b + 2, :lanes])
    ids = np.empty(((whole - 1) * streams * steps + tail * streams), np.uint32)
    full = ids[: (whole - 1) * streams * steps].reshape(-1, steps)
    for i in range(0, len(full), 64):  # few lanes at a time stay in the cache
        full[i : i + 64] = past[2:, i : min(i + 64, len(full))].T
    ids[full.size :].reshape(streams, tail)[:] = past[2 : tail + 2, len(full) : len(full) + streams].T
    ids = ids[:total]
    plain = ids.astype("<u4", copy=False)
    for i in range(whole):
        if zlib.crc32(plain[i * size : (i + 1) * size]) != crc[i]:
            raise ValueError(f"block {i} is damaged")
    return ids


def _cuts() -> np.ndarray:
    """For each pair of kinds (none, letter, digit, sign, apostrophe) of ASCII characters: whether a word ends between them."""
    cut = np.ones((5, 5), dtype=bool)
    cut[0], cut[:, 0], cut[1, 1], cut[3:, 3:], cut[4, 1] = False, False, False, False, False  # 's and its like are words
    return cut.ravel()


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


_KIND = bytes(0 if not 33 <= c < 127 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 4 if c == 39 else 3 for c in range(256))
_CUT = _cuts().astype(np.uint8).tobytes().ljust(256, b"\0")
_LOWERED = bytes(range(256)).lower()


class Words:
    """Ids of texts by the tokenizers library, remembered for each white-space-free run up to a bound.

    No token of a tokenizer that drops white space spans it, and neither does its normaliser. Where the tokenizer also
    ends words between ASCII letters, digits and signs (tried on a few texts), runs are cut there too, which makes few
    of them. Texts with `<|`, as special tokens have it, are neither cut nor lower-cased.

    Runs of Latin letters alone need neither normaliser nor regular expression: the library encodes them, in lower case, by
    the same model, split at spaces, if each such letter, alone and inside a word, then has the ids that it has with both."""

    REMEMBERED, TOGETHER = 1_000_000, 100

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        own = lambda text: self.library.encode(text, add_special_tokens=False).ids
        probe = (("ab.cd,e1 23's$x(y)-z'q", "ab . cd , e 1 2 3 's $ x ( y )- z 'q"), ("a'sb''c4.5%'t7", "a 'sb ''c 4 . 5 %'t 7"))
        self.cut = all(own(x) == own(y) for x, y in probe)
        self.lower = all(own(chr(c)) == own(chr(c).lower()) for c in range(65, 91))
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and c != "\u0130"]
        for text in (" ".join(letters), " ".join(f"a{c}b{c}" for c in letters)):
            if own(text) != self.plain.encode(text.lower(), add_special_tokens=False).ids:
                self.plain = self.library
        ends = [t.endswith("</w>") for t, _ in sorted(self.library.get_vocab().items(), key=lambda x: x[1])]
        self.ends = np.array(ends, dtype=bool)  # tokens that end a word
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.start, self.size, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _add(self, fresh: list[bytes]) -> None:
        """Ids of new runs. Those of Latin letters alone are one word each and go to the library many in one text."""
        texts = [raw.decode("utf-8", "replace") for raw in fresh]
        plain = [i for i, t in enumerate(texts) if t.isalpha() and (t.isascii() or max(t) < "\u0250" and "\u0130" not in t)]
        parts = [plain[a : a + self.TOGETHER] for a in range(0, len(plain), self.TOGETHER)]
        order, sizes, flats = [], [], []
        joined = [" ".join([texts[i] for i in p]) for p in parts]
        if self.plain is not self.library:
            joined = [t.lower() for t in joined]
        for part, e in zip(parts, self.plain.encode_batch_fast(joined, add_special_tokens=False)):
            flat = np.array(e.ids, np.int32)
            last = np.flatnonzero(self.ends.take(flat))
            if len(last) == len(part) and last[-1] == len(flat) - 1:  # each run has ended once
                order += part
                sizes.append(np.diff(last, prepend=-1))
                flats.append(flat)
        done = set(order)
        rest = [i for i in range(len(texts)) if i not in done]
        ids = [e.ids for e in self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        size = np.concatenate([*sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
        self.known.update(zip([fresh[i] for i in order + rest], range(len(self.size), len(self.size) + len(fresh))))
        self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.flat = np.concatenate([self.flat, *flats, np.fromiter(chain.from_iterable(ids), np.int32)])

    def _runs(self, data: np.ndarray, offsets: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The number of each run, and how many each text has."""
        if plain and self.lower:
            data = _mapped(data, _LOWERED)
        if plain and self.cut and len(data):
            kind = _mapped(data, _KIND)
            at = np.flatnonzero(_mapped(kind[:-1] * np.uint8(5) + kind[1:], _CUT)) + 1
            data, offsets = np.insert(data, at, 32), offsets + np.searchsorted(at, offsets, "left")
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.values.dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(number < 0)
        if len(self.known) + len(missing) > self.REMEMBERED:
            self._clear()
            missing = np.flatnonzero(number)  # all but the empty run
        if len(missing):
            fresh = [distinct[i] for i in missing.tolist()]
            self._add(fresh)
            number[missing] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        return number.take(coded.indices.to_numpy()), np.diff(lists.offsets.to_numpy())

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For parts of the texts: the ids of their texts one after another, END behind each, and how many each has with it."""
        special = pc.fill_null(pc.match_substring(texts, "<|"), False).to_numpy(zero_copy_only=False)
        borders = [0, *(np.flatnonzero(special[1:] != special[:-1]) + 1).tolist(), len(special)]
        for x, y in zip(borders[:-1], borders[1:]):
            data, offsets = strings(texts.slice(x, y - x))
            for _, _, part, off in byte_chunks(data, offsets, 1 << 23):
                index, runs = self._runs(part, off, not special[x])
                size = self.size.take(index)
                ends = np.append(0, np.cumsum(size))
                flat = self.flat.take(np.arange(ends[-1]) + np.repeat(self.start.take(index) - ends[:-1], size))
                borders_ = ends[np.cumsum(runs)]
                yield np.insert(flat, borders_, END), np.diff(borders_, prepend=0) + 1


_words: dict[str, Words] = {}


def segment_batches(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text) in order: segments with their documents' ids and numbers of tokens."""
    words = _words.setdefault(path, Words(path)) if path not in _words else _words[path]
    part, seg = TaskContext.get().partitionId(), 0
    docs: list = []
    counts: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def segment() -> pa.RecordBatch:
        payload = encode(np.concatenate(held))
        count = np.concatenate(counts)
        return pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int64()), "seg": pa.array([seg], pa.int64()), "n": pa.array([int(count.sum())], pa.int64()),
            "doc_ids": pa.array([docs], pa.list_(pa.int64())), "counts": pa.array([count], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary()),
        })

    size = 0
    for batch in batches:
        ids, a = batch.column("doc_id").to_pylist(), 0
        for flat, count in words.encode(batch.column("text")):
            held.append(flat)
            counts.append(count)
            docs += ids[a : a + len(count)]
            size += len(flat)
            a += len(count)
            if size >= SEGMENT:
                yield segment()
                seg, size, docs, counts, held = seg + 1, 0, [], [], []
    if docs:
        yield segment()


def document_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments with their first position: each document's start, number of tokens and CRC-32, from decoded ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids = decode(batch.column("payload")[i].as_py()).astype("<u4")
            docs, count = batch.column("doc_ids")[i].values, batch.column("counts")[i].values.to_numpy()
            ends = np.cumsum(count)
            if len(ids) != (ends[-1] if len(ends) else 0):
                raise ValueError("a segment does not hold its documents' ids")
            start = ends - count
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [docs, pa.array(start + batch.column("first")[i].as_py()), pa.array(count), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_ids(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order as a table of segments; returns the table as read back.

    Rows: part, seg (order), n (ids), doc_ids, counts (ids of each document, END included) and payload. A null or empty
    text has END alone. Null doc_ids come first; rows repeating a doc_id stay apart. An empty table gives no segments.
    Text is shuffled once, by ranges of doc_id and of a hash of the text, so that one doc_id of many rows is split too.
    `path` defaults to a folder of the shared scratch space."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    segments = ordered.mapInArrow(lambda it: segment_batches(it, tokenizer), "part long, seg long, n long, doc_ids array<long>, counts array<long>, payload binary")
    if path is None:
        return land(segments)
    segments.write.parquet(path)
    return docs.sparkSession.read.schema(segments.schema).parquet(path)


def read_ids(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, all from the decoded segments.

    The first position of each part is a running sum over parts, of which there are as many as shuffle partitions."""
    index = segments.select("part", "seg", "n")
    whole = index.groupBy("part").agg(F.sum("n").alias("all"))
    before = whole.withColumn("base", F.sum("all").over(Window.orderBy("part")) - F.col("all")).select("part", "base")
    inside = Window.partitionBy("part").orderBy("seg")
    firsts = index.withColumn("own", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(before), "part").select("part", "seg", (F.col("own") + F.col("base")).alias("first"))
    spread = segments.join(firsts, ["part", "seg"]).select("first", "doc_ids", "counts", "payload")
    return spread.mapInArrow(document_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")
