"""Least-cost repair of the structure of conversations, by dynamic programming over a grammar.

A turn becomes one of nine symbols: its role (system, user, assistant, other) with a whole or a truncated text, or a row
that has to go (blank, or a role and text seen earlier in the conversation). The symbols of many conversations are
compressed together by Re-Pair: the commonest pair of neighbours becomes a rule, until no pair occurs twice.

A symbol is a min-plus matrix over the four states of the wanted form `(s?(ua)+)?`: nothing yet, after s, after u, after
a. Entry (i, j) is the least cost of the edits that lead from i to j, inserted turns before the row included. A rule's
matrix is the product of its two parts' matrices; it is computed once, bottom-up, and serves all conversations.

The edits themselves are a rope: for (rule, i, j) the state between the two parts, so a text of edits is only written
for the conversations' own paths. Among equally cheap edits the ASCII-least text wins. Comparing texts is not needed: two
different texts of edits of the same rows end in a row's edit each, so neither begins with the other, and they end in
different states if they start in the same one. So it is enough to keep, for each start state, the rank of the four
texts: a product compares the ranks of its left parts, and those of its right parts where the left ones are the same.

Rows are sorted by conversation in range partitions and cut into pieces of bounded size, so a conversation of any length
is spread over tasks. Conversations that lie in one piece are finished there; of the others the pieces' matrices are
multiplied in order, and the pieces then write their edits. Only the SHA-256 of one conversation's repaired text, which
is sequential by definition, and its one text of edits pass through one task, piece by piece.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Symbols of a piece and characters of its texts (one longer text makes a longer piece); symbols compressed together.
PIECE, CHARS, TOGETHER = 4096, 1 << 20, 1 << 17
GONE = 8  # the symbol of rows that have to go; others are 2 * role + truncated, with roles in order s, u, a, other
_OTHER, _FAR = 3, 1 << 40
_NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # the state after a turn that is inserted or gets a new role
_TURN = {2: "user", 3: "assistant"}


def _terminal(symbol: int) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], str]]:
    """Costs, ranks and texts of a row's edits, with turns inserted before it."""
    found: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(i: int, j: int, cost: int, text: str) -> None:
        found[i, j] = min(found.get((i, j), (_FAR, "")), (cost, text))

    role, cut = divmod(symbol, 2)
    for start in range(4):
        at, cost, text = start, 0, ""
        for _ in range(4):  # more inserted turns come back to a state at a higher cost
            offer(start, at, cost + DELETE, text + "D")
            if symbol != GONE:
                offer(start, _NEXT[at], cost + REROLE + cut * TRUNCATED, text + "R")
                to = {0: 1 if at == 0 else None, 1: 2 if at != 2 else None, 2: 3 if at == 2 else None}.get(role)
                if to is not None:
                    offer(start, to, cost + KEEP + cut * TRUNCATED, text + "K")
            at, cost, text = _NEXT[at], cost + INSERT, text + "I"
    cost, rank = np.full((4, 4), _FAR, np.int64), np.full((4, 4), 3, np.int64)
    for i in range(4):
        ends = sorted((j for j in range(4) if (i, j) in found), key=lambda j: found[i, j][1])
        for r, j in enumerate(ends):
            cost[i, j], rank[i, j] = found[i, j][0], r
    return cost, rank, {k: v[1] for k, v in found.items()}


_TERMINALS = [_terminal(s) for s in range(GONE + 1)]
_COST = np.stack([t[0] for t in _TERMINALS])
_RANK = np.stack([t[1] for t in _TERMINALS])


def product(a_cost: np.ndarray, a_rank: np.ndarray, b_cost: np.ndarray, b_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Min-plus products of pairs of (n, r, 4) and (n, 4, 4): costs, ranks and the states between."""
    both = a_cost[:, :, :, None] + b_cost[:, None, :, :]
    mid = (both * 4 + a_rank[:, :, :, None]).argmin(2)
    cost = np.minimum(np.take_along_axis(both, mid[:, :, None, :], 2)[:, :, 0, :], _FAR)
    left = np.take_along_axis(a_rank, mid, 2)
    right = b_rank[np.arange(len(mid))[:, None, None], mid, np.arange(4)]
    order = np.where(cost < _FAR, left * 4 + right, 99)
    return cost, order.argsort(2, kind="stable").argsort(2, kind="stable"), mid


def re_pair(sequences: Iterable[bytes]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules (pairs of symbols; rule k is symbol GONE + 1 + k) and the sequences written with them."""
    symbol: list[int] = []
    for s in sequences:
        symbol.extend(s)
        symbol.append(-1)
    n = len(symbol)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in range(n - 1):
        if symbol[i] >= 0 <= symbol[i + 1]:
            where[symbol[i], symbol[i + 1]].add(i)
    heap = [(-len(at), pair) for pair, at in where.items()]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap and heap[0][0] <= -2:
        count, pair = heapq.heappop(heap)
        now = len(where.get(pair, ()))
        if now != -count:
            if now >= 2:
                heapq.heappush(heap, (-now, pair))
            continue
        new, (a, b), fresh = GONE + 1 + len(rules), pair, set()
        rules.append(pair)
        for i in sorted(where.pop(pair)):
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # it overlapped one that was replaced
            p, q = before[i], after[j]
            if p >= 0 and symbol[p] >= 0:
                where[symbol[p], a].discard(p)
                where[symbol[p], new].add(p)
                fresh.add((symbol[p], new))
            if q < n and symbol[q] >= 0:
                where[b, symbol[q]].discard(j)
                where[new, symbol[q]].add(i)
                fresh.add((new, symbol[q]))
            symbol[i], symbol[j], after[i] = new, -2, q
            if q < n:
                before[q] = i
        where.pop(pair, None)
        for x in fresh:
            heapq.heappush(heap, (-len(where[x]), x))
    out: list[list[int]] = [[]]
    i = 0
    while i < n:
        if symbol[i] == -1:
            out.append([])
        else:
            out[-1].append(symbol[i])
        i = after[i]
    return rules, out[:-1]


class Grammar:
    """The matrices of the rules of some symbol sequences, and the products of the sequences themselves."""

    def __init__(self, sequences: Iterable[bytes]):
        self.number = {s: k for k, s in enumerate(dict.fromkeys(sequences))}
        self.rules, self.starts = re_pair(self.number)
        size = GONE + 1 + len(self.rules)
        self.mid = np.zeros((size, 4, 4), np.int8)
        cost, rank = np.concatenate([_COST, np.zeros((len(self.rules), 4, 4), np.int64)]), np.concatenate([_RANK, np.zeros((len(self.rules), 4, 4), np.int64)])
        level, levels = [0] * size, defaultdict(list)
        for k, (a, b) in enumerate(self.rules):
            level[GONE + 1 + k] = 1 + max(level[a], level[b])
            levels[level[GONE + 1 + k]].append(k)
        for _, ks in sorted(levels.items()):
            a, b = np.array([self.rules[k] for k in ks]).T
            at = np.array(ks) + GONE + 1
            cost[at], rank[at], self.mid[at] = product(cost[a], rank[a], cost[b], rank[b])
        # sequences side by side, the longest first: step t multiplies all that have a symbol t
        order = sorted(range(len(self.starts)), key=lambda k: -len(self.starts[k]))
        self.row = {k: r for r, k in enumerate(order)}
        first = np.array([self.starts[k][0] for k in order if self.starts[k]], np.int64)
        self.cost, self.rank, self.steps = cost[first], rank[first], []
        for t in range(1, max(map(len, self.starts), default=0)):
            at = np.array([self.starts[k][t] for k in order[: sum(1 for _ in self._longer(order, t))]], np.int64)
            m = len(at)
            self.cost[:m], self.rank[:m], mid = product(self.cost[:m], self.rank[:m], cost[at], rank[at])
            self.steps.append(mid.astype(np.int8))

    def _longer(self, order: list[int], t: int) -> Iterator[int]:
        for k in order:
            if len(self.starts[k]) <= t:
                return
            yield k

    def matrix(self, sequence: bytes) -> tuple[np.ndarray, np.ndarray]:
        r = self.row[self.number[sequence]]
        return self.cost[r], self.rank[r]

    def edits(self, sequence: bytes, i: int, j: int) -> str:
        """The text of the cheapest edits from state i to j."""
        k = self.number[sequence]
        row, start, todo = self.row[k], self.starts[k], []
        for t in range(len(start) - 1, 0, -1):
            m = int(self.steps[t - 1][row, i, j])
            todo.append((start[t], m, j))
            j = m
        todo.append((start[0], i, j))
        out = []
        while todo:
            s, i, j = todo.pop()
            if s <= GONE:
                out.append(_TERMINALS[s][2][i, j])
            else:
                a, b = self.rules[s - GONE - 1]
                m = int(self.mid[s, i, j])
                todo += ((b, m, j), (a, i, m))
        return "".join(out)


def closing(cost: np.ndarray, rank: np.ndarray) -> tuple[int, int, str]:
    """From the four costs and ranks at the end of the rows: the least cost, its last state and the turns inserted there."""
    best = min((int(cost[j]) + len(more) * INSERT, int(rank[j]), j, more) for j, more in ((0, ""), (1, "II"), (2, "I"), (3, "")))
    return best[0], best[2], best[3]


def written(edits: str, symbols: bytes, state: int, turns: list[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the edits leave or make, from a state on; `turns` has the rows that need not go."""
    row = turn = 0
    for e in edits:
        if e == "I":
            state = _NEXT[state]
            yield e, _TURN[state], ""
            continue
        s = symbols[row]
        row += 1
        if s == GONE:
            continue
        role, text = turns[turn]
        turn += 1
        if e == "R":
            state = _NEXT[state]
            yield e, _TURN[state], text
        elif e == "K":
            state = s // 2 + 1
            yield e, role, text


def _joined(lines: Iterable[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in lines)


def classified(rows: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, text) of (conv_id, turn, role, text, copies): copies, whether it is the first with
    its role and text in the conversation, and what is wrong with its text. The text itself is shuffled once."""
    base = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    first = base.groupBy("conv_id", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))).alias("m"))
    both = base.select("conv_id", "turn", "role", "key", "text", "copies", F.lit(0).alias("first")).unionByName(
        first.select("conv_id", "m.turn", "role", "key", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(1).alias("first"))
    )
    one = both.groupBy("conv_id", "turn", "role", "key").agg(F.max("text").alias("text"), F.sum("copies").alias("copies"), F.max("first").alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    role = F.left("role", F.lit(1))
    return one.select(
        "conv_id", "turn", "role", "text", "copies", F.col("first") == 1, (bare == "").alias("blank"), ~F.right(bare, F.lit(1)).isin(".", "!", "?"),
        F.when(role == "s", 0).when(role == "u", 1).when(role == "a", 2).otherwise(_OTHER),
    ).toDF("conv_id", "turn", "role", "text", "copies", "first", "blank", "cut", "kind")


_LEGAL = {(0, 1), (1, 2), (2, 1)}
_NUMBERS = ("blank", "duplicate", "truncated", "illegal", "turns")
_PIECE = "part int, piece long, whole boolean, symbols binary, roles array<string>, texts array<string>, first_turn long, last_turn long, first_kind int, last_kind int, blank long, duplicate long, truncated long, illegal long, turns long"


class _Piece:
    """Rows of one conversation, in order."""

    def __init__(self, conv: Any):
        self.conv, self.symbols, self.roles, self.texts, self.chars = conv, bytearray(), [], [], 0
        self.first_turn = self.last_turn = self.first_kind = self.last_kind = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0

    def add(self, turn: int | None, kind: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.last_kind is None:
            self.first_kind = kind
        elif (self.last_kind, kind) not in _LEGAL:
            self.illegal += 1
        self.last_kind = kind


def _pieces(batches: Iterable[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of sorted rows; `whole` if the conversation surely has no other piece: it is neither the first nor the last here."""
    part, number, first_conv = TaskContext.get().partitionId(), 0, True
    held: list[_Piece] = []  # of the conversation at hand
    done: list[tuple[_Piece, bool]] = []

    def out() -> pa.RecordBatch:
        nonlocal number
        rows = []
        for p, whole in done:
            rows.append({"conv_id": p.conv, "part": part, "piece": number, "whole": whole, "symbols": bytes(p.symbols)} | {k: getattr(p, k) for k in ("roles", "texts", "first_turn", "last_turn", "first_kind", "last_kind", *_NUMBERS)})
            number += 1
        done.clear()
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    chars = 0
    for batch in batches:
        for conv, turn, role, text, copies, first, blank, cut, kind in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "copies", "first", "blank", "cut", "kind"))):
            if held and held[0].conv != conv:
                chars += sum(p.chars for p in held)
                done += [(p, len(held) == 1 and not first_conv) for p in held]
                held, first_conv = [], False
            elif len(held) > 1:  # a long conversation: what is full can go
                chars += sum(p.chars for p in held[:-1])
                done += [(p, False) for p in held[:-1]]
                held, first_conv = held[-1:], True
            if chars > CHARS or len(done) > 1000:
                yield out()
                chars = 0
            if not held:
                held.append(_Piece(conv))
            for c in range(copies):
                p = held[-1]
                if len(p.symbols) >= most or p.chars > CHARS:
                    if len(held) > 1:
                        done += [(x, False) for x in held[:-1]]
                        held, first_conv = held[-1:], True
                        if len(done) > 1000:
                            yield out()
                    p = _Piece(conv)
                    held.append(p)
                p.add(turn, kind)
                if blank:
                    p.blank += 1
                    p.symbols.append(GONE)
                elif c or not first:
                    p.duplicate += 1
                    p.symbols.append(GONE)
                else:
                    p.truncated += cut
                    p.symbols.append(2 * kind + cut)
                    p.roles.append(role)
                    p.texts.append(text)
                    p.chars += len(text)
    done += [(p, False) for p in held]
    if done:
        yield out()


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Pieces whose symbols are compressed together."""
    held, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            held.append(row)
            size += len(row["symbols"]) + sum(map(len, row.get("texts") or ())) // 64
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _finish(batches: Iterable[pa.RecordBatch], schema: pa.Schema, turns: bool) -> Iterator[pa.RecordBatch]:
    """Whole conversations: their result, or the turns of the repaired ones."""
    for rows in _together(batches):
        grammar, known, out = Grammar(r["symbols"] for r in rows), {}, []
        for r in rows:
            s = r["symbols"]
            if s not in known:
                cost, end, more = closing(*(m[0] for m in grammar.matrix(s)))
                known[s] = cost, grammar.edits(s, 0, end) + more
            cost, edits = known[s]
            lines = written(edits, s, 0, list(zip(r["roles"], r["texts"])))
            if turns:
                out += [{"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"], "place": k, "edit": e, "role": role, "text": text} for k, (e, role, text) in enumerate(lines)]
            else:
                out.append({"conv_id": r["conv_id"], "gaps": _gaps(r["first_turn"], r["last_turn"], r["turns"]), **{k: r[k] for k in _NUMBERS[:4]}, "cost": cost, "audit": edits, "repaired_sha256": hashlib.sha256(_joined(lines).encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _matrices(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for rows in _together(batches):
        grammar = Grammar(r["symbols"] for r in rows)
        out = []
        for r in rows:
            cost, rank = grammar.matrix(r["symbols"])
            out.append(r | {"cost": cost.ravel().tolist(), "rank": rank.ravel().tolist()})
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in out], schema=schema)


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """Rows sorted by conversation, one conversation after the other; each is a stream of its rows."""
    from itertools import groupby

    for conv, rows in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["conv_id"]):
        yield conv, rows


def _chosen(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each piece of a conversation the states it leads from and to; the last one also has the conversation's figures."""
    for conv, rows in _runs(batches):
        cost, rank = np.full((1, 1, 4), _FAR), np.full((1, 1, 4), 3)
        cost[0, 0, 0] = rank[0, 0, 0] = 0
        mids, places = bytearray(), []
        total, first, last, kind = dict.fromkeys(_NUMBERS, 0), None, None, None
        for r in rows:
            cost, rank, mid = product(cost, rank, np.array(r["cost"]).reshape(1, 4, 4), np.array(r["rank"]).reshape(1, 4, 4))
            mids += mid.astype(np.uint8).tobytes()
            places.append((r["part"], r["piece"]))
            for k in _NUMBERS:
                total[k] += r[k]
            total["turns"] -= last is not None and last == r["first_turn"]
            total["illegal"] += kind is not None and (kind, r["first_kind"]) not in _LEGAL
            kind = r["last_kind"]
            first = r["first_turn"] if first is None else first
            last = r["last_turn"] if r["last_turn"] is not None else last
        least, state, more = closing(cost[0, 0], rank[0, 0])
        out = []
        for k in range(len(places) - 1, -1, -1):
            end = k == len(places) - 1
            before = mids[4 * k + state]
            out.append({
                "part": places[k][0], "piece": places[k][1], "from": before, "to": state, "more": more if end else "",
                "gaps": _gaps(first, last, total["turns"]) if end else None, **{n: total[n] if end else None for n in _NUMBERS[:4]}, "least": least if end else None,
            })
            state = before
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _rewritten(batches: Iterable[pa.RecordBatch], schema: pa.Schema, turns: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of long conversations: their edits and repaired text, or the turns of that text."""
    for rows in _together(batches):
        grammar, out = Grammar(r["symbols"] for r in rows), []
        for r in rows:
            edits = grammar.edits(r["symbols"], r["from"], r["to"])
            lines = list(written(edits, r["symbols"], r["from"], list(zip(r["roles"], r["texts"]))))
            lines += written(r["more"], b"", r["to"], [])
            if turns:
                out += [{"conv_id": r["conv_id"], "part": r["part"], "piece": r["piece"], "place": k, "edit": e, "role": role, "text": text} for k, (e, role, text) in enumerate(lines)]
            else:
                out.append({k: r[k] for k in schema.names if k in r} | {"edits": edits + r["more"], "repaired": _joined(lines) if lines else None})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _assembled(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces of a conversation, in order, as one row: the texts go through the hash and are not kept."""
    for conv, rows in _runs(batches):
        sha, begun, edits, last = hashlib.sha256(), False, [], {}
        for r in rows:
            edits.append(r["edits"])
            if r["repaired"] is not None:
                sha.update(b"\n" * begun + r["repaired"].encode())
                begun = True
            last = r
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "gaps": last["gaps"], **{k: last[k] for k in _NUMBERS[:4]}, "cost": last["least"], "audit": "".join(edits), "repaired_sha256": sha.hexdigest()}], schema=schema)


def _mapped(df: DataFrame, f: Any, columns: str, *more: Any, conv: bool = True) -> DataFrame:
    """mapInArrow with f(batches, arrow schema, ...); the result has conv_id as df does, and the columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(([df.schema["conv_id"]] if conv else []) + T.StructType.fromDDL(columns).fields)
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: f(batches, arrow, *more), schema)


def _by_conversation(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Repaired:
    """Conversations of (conv_id, turn, role, text, copies), repaired at least cost. Rows are taken by turn (nulls first),
    of equal turns by role and text; roles and texts must not be null. Building one lands the pieces once."""

    def __init__(self, rows: DataFrame, piece: int = PIECE):
        order = ["conv_id", "turn", "role"]
        kind = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.col("copies").cast("long").alias("copies"))
        # the first 128 characters tell a range's bounds, so the driver sees no long text
        spread = classified(kind).repartitionByRange(*order, F.left("text", F.lit(128))).sortWithinPartitions(*order, "text")
        self.pieces = land(_mapped(spread, _pieces, _PIECE, piece))
        self.whole, rest = self.pieces.filter("whole"), self.pieces.filter("not whole")
        numbers = ", ".join(f"{k} long" for k in _NUMBERS)
        facts = _mapped(rest.drop("roles", "texts"), _matrices, f"part int, piece long, first_turn long, last_turn long, first_kind int, last_kind int, {numbers}, cost array<long>, rank array<long>")
        chosen = _mapped(_by_conversation(facts), _chosen, "part int, piece long, from int, to int, more string, gaps long, blank long, duplicate long, truncated long, illegal long, least long", conv=False)
        self.rest = rest.select("conv_id", "part", "piece", "symbols", "roles", "texts").join(chosen, ["part", "piece"])

    def conversations(self) -> DataFrame:
        """One row a conversation that has rows: the faults, the cost, the edits and the repaired text's SHA-256."""
        parts = _mapped(self.rest, _rewritten, "part int, piece long, edits string, repaired string, gaps long, blank long, duplicate long, truncated long, illegal long, least long", False)
        return _mapped(self.whole, _finish, _RESULT, False).unionByName(_mapped(_by_conversation(parts), _assembled, _RESULT))

    def turns(self) -> DataFrame:
        """The repaired turns (conv_id, part, piece, place, edit, role, text); a conversation's are in order of part, piece, place."""
        columns = "part int, piece long, place int, edit string, role string, text string"
        return _mapped(self.whole, _finish, columns, True).unionByName(_mapped(self.rest, _rewritten, columns, True))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the planned damage; a null role or text, and a null in the hashed key, is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text: Column = F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(lot == 4, F.lit("user")).otherwise(space("role"))
    copies = F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def repaired_conversations(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each conv_id of (conv_id, turn, role, text) after the planned damage, also for one that lost all rows.

    Null roles and texts count as one space, a null conv_id is a conversation of its own, null turns come first and don't
    count for gaps; rows of one turn are taken by role and text, and of equal ones all but the first are duplicates. Other
    columns are ignored; an empty table gives no rows."""
    left = damaged(rows)
    found = Repaired(left.filter("copies > 0"), piece).conversations()
    empty = left.groupBy("conv_id").agg(F.max("copies").alias("most")).filter("most = 0")
    zero = [F.lit(0).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.unionByName(empty.select("conv_id", *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256(b"").hexdigest()).alias("repaired_sha256")))
