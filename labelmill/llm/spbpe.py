"""SentencePiece BPE with byte fallback, encoded by vectorised merge rounds and decoded by the library.

A text becomes units that no piece of the model crosses (a unit starts where U+2581 follows another character, and at
line ends where the model keeps them apart). Distinct units are merged together as one flat numpy array of symbols:
in each round every unit finds its best pair, all its leftmost occurrences that cannot disturb one another merge at
once, and finished units leave the arrays, until no pair remains. Units are remembered per task, up to a bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Symbols from here on stand for characters that are no piece of their own.
_CHAR = 1 << 21
_NONE = np.iinfo(np.int32).max
#: Units remembered by one task before it starts anew.
REMEMBERED = 400_000


class MergeTable:
    """Pieces, pair ranks and byte pieces read from a model file of type BPE."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        pieces = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        ordered = np.unique([-sp.get_score(i) for i in pieces.values()])
        self.code = {p: i for p, i in pieces.items() if len(p) == 1}
        rows, crossing, self.cuts_newline = [], False, True
        for piece, i in pieces.items():
            crossing |= SPACE in piece.lstrip(SPACE)
            self.cuts_newline &= len(piece) == 1 or "\n" not in piece
            rank = int(np.searchsorted(ordered, -sp.get_score(i)))
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if (len(left) == 1 or left in pieces) and (len(right) == 1 or right in pieces):
                    rows.append(((pieces.get(left, _CHAR + ord(left[0])) << 32) | pieces.get(right, _CHAR + ord(right[0])), rank, i))
        if crossing:
            raise ValueError("a piece crosses a word start; this model needs other units")
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.merged = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.unit = re.compile(self._unit_pattern(pieces))
        self.char_code = np.arange(_CHAR, _CHAR + 0x110000, dtype=np.int32)
        for char, i in self.code.items():
            self.char_code[ord(char)] = i
        spaces = [p for p in pieces if p.strip(SPACE) == ""]
        self.widest = max(map(len, spaces), default=1)
        # runs of spaces that pair with equal ranks fill from the left, one widest piece after another
        self.even_spaces = sorted(map(len, spaces)) == list(range(1, self.widest + 1)) and len({sp.get_score(pieces[p]) for p in spaces if len(p) > 1}) == 1 and (
            min(sp.get_score(i) for p, i in pieces.items() if len(p) > 1) == sp.get_score(pieces[SPACE * 2]) if self.widest > 1 else True
        )
        self._check()

    def _check(self) -> None:
        """What units() takes for granted (a dummy prefix, escaped spaces, characters left as they are) holds for this model."""
        for text in ("a b", "  two   spaces ", "\n\tline\r\n", "\uff21\ufb01\u2460 e\u0301\u00e9", "\u2581x \u200b", "\u6f22\U0001f600 A1.5"):
            if [i for own in self.ids(self.units(text)) for i in own] != self.library.encode(text):
                raise ValueError(f"this model's normaliser or prefix is not supported: {text!r}")

    def _unit_pattern(self, pieces: dict[str, int]) -> str:
        """A unit: spaces, then up to the end of a run of letters, where no piece goes from a letter to what follows."""
        stop = "\n" if self.cuts_newline else ""
        letter = re.compile(r"[^\W\d_]")
        over = {(p[i - 1], p[i]) for p in pieces for i in range(1, len(p)) if letter.match(p[i - 1]) and not letter.match(p[i])}
        if len(over) > 20:
            return f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + "|\n+" * self.cuts_newline
        odd = "".join(sorted({re.escape(a) for a, _ in over if not a.isascii()}))
        on = "".join(sorted({re.escape(b) for a, b in over if a.isascii()}))
        tail = f"(?:[{on}][^{SPACE}{stop}]*)?" if on else ""
        run = rf"(?:[^\W\d_{odd}]+{tail})"
        return rf"{SPACE}*(?:{run}|(?:[\W\d_{odd}](?<![{SPACE}{stop or SPACE}]))+{run}?)|{SPACE}+" + "|\n+" * self.cuts_newline

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.merged[at], -1)

    def merge(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of all units, flat, and the number of symbols of each unit."""
        length = np.array([len(u) for u in units], dtype=np.int64)
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sym = self.char_code[points]
        seg = np.repeat(np.arange(len(units), dtype=np.int32), length)
        done_sym, done_seg = [], []
        rank, into = self._pairs(sym, seg)
        while len(sym):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(rank, first)
            span = np.diff(np.append(first, len(sym)))
            each = np.repeat(best, span)
            active = each != _NONE
            if not active.all():  # compaction: units without a pair are finished
                done_sym.append(sym[~active])
                done_seg.append(seg[~active])
                sym, seg, rank, into, each = sym[active], seg[active], rank[active], into[active], each[active]
                if not len(sym):
                    break
            take = rank == each
            at = np.flatnonzero(take)
            head = np.append(True, at[1:] != at[:-1] + 1)
            run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]  # of overlapping pairs the leftmost, then every second
            best = each[at]
            lead = np.append(True, seg[at[1:]] != seg[at[:-1]])
            after_merge = np.append(False, at[1:] == at[:-1] + 2) & ~lead
            prev = np.where(after_merge, into[np.maximum(at - 2, 0)], sym[np.maximum(at - 1, 0)])
            left = np.where((at > 0) & (seg[np.maximum(at - 1, 0)] == seg[at]), self.lookup(prev, into[at])[0], _NONE)
            nxt = np.minimum(at + 2, len(sym) - 1)
            right = np.where((at + 2 < len(sym)) & (seg[nxt] == seg[at]), self.lookup(into[at], sym[nxt])[0], _NONE)
            early = (left <= best) | (right <= best)
            if early.any():  # a new pair would come first: that unit merges only its leftmost pair now
                bad = np.zeros(int(seg[-1]) + 1, dtype=bool)
                bad[seg[at[early]]] = True
                at = at[lead | ~bad[seg[at]]]
            sym[at] = into[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            spot = np.cumsum(keep)[at] - 1
            sym, seg, rank, into = sym[keep], seg[keep], rank[keep], into[keep]
            touched = np.zeros(len(sym), dtype=bool)
            touched[spot] = True
            touched[spot[spot > 0] - 1] = True
            redo = np.flatnonzero(touched)
            rank[redo], into[redo] = self._at(sym, seg, redo)
        sym, seg = np.concatenate([*done_sym, sym[:0]]), np.concatenate([*done_seg, seg[:0]])
        order = np.argsort(seg, kind="stable")
        return sym[order], np.bincount(seg, minlength=len(units))

    def _at(self, sym: np.ndarray, seg: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = np.minimum(at + 1, len(sym) - 1)
        rank, into = self.lookup(sym[at], sym[nxt])
        alone = (nxt == at) | (seg[nxt] != seg[at])
        rank[alone] = _NONE
        return rank, into

    def _pairs(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._at(sym, seg, np.arange(len(sym))) if len(sym) else (sym.copy(), sym.copy())

    def units(self, text: str) -> list[str]:
        """The text with its dummy prefix and escaped spaces, cut where no piece can cross."""
        if not text:
            return []
        out = self.unit.findall(SPACE + text.replace(" ", SPACE))
        if self.even_spaces and SPACE * (self.widest + 2) in text.replace(" ", SPACE):
            cut = []
            for u in out:
                run = len(u) - len(u.lstrip(SPACE))
                whole = max(0, run - 1) // self.widest
                cut += [SPACE * self.widest] * whole + [u[whole * self.widest :]]
            out = cut
        return out

    def ids(self, units: list[str]) -> list[list[int]]:
        if not units:
            return []
        sym, size = self.merge(units)
        flat, ends = sym.tolist(), np.cumsum(size).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for k in np.unique(np.repeat(np.arange(len(units)), size)[sym >= _CHAR]).tolist():
            out[k] = [i for s in out[k] for i in ([s] if s < _CHAR else self._bytes(chr(s - _CHAR)))]
        return out

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]


_tables: dict[str, MergeTable] = {}


def encoder(model_path: str) -> MergeTable:
    """The table of a model, read once in a Python worker."""
    if model_path not in _tables:
        _tables[model_path] = MergeTable(model_path)
    return _tables[model_path]


class Memory:
    """Units seen by this task and their ids; it starts anew beyond a bound, which changes no result."""

    def __init__(self, table: MergeTable):
        self.table, self.known = table, {}

    def encode(self, texts: list[str]) -> list[list[tuple[list[int], str]]]:
        """For each text its units in order: their ids, and these as decimal numbers joined by commas."""
        split = [self.table.units(t) for t in texts]
        new: set[str] = set()
        for us in split:
            new.update(us)
        fresh = list(new.difference(self.known))
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known, fresh = {}, list(new)
        self.known.update((u, (i, ",".join(map(str, i)))) for u, i in zip(fresh, self.table.ids(fresh)))
        get = self.known.__getitem__
        return [list(map(get, us)) for us in split]


def _slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def coded_batches(batches: Iterable[pa.RecordBatch], model_path: str, text: str, digests: bool) -> Iterator[pa.RecordBatch]:
    table = encoder(model_path)
    memory = Memory(table)
    for batch in batches:
        names = batch.schema.names
        rows = batch.column(names.index(text))
        at = 0
        for part in _slices(rows.to_pylist()):
            coded = memory.encode(part)
            ids = [[i for own, _ in units for i in own] for units in coded]
            decoded = [table.library.decode(x) if x else "" for x in ids]
            rest = batch.slice(at, len(part))
            at += len(part)
            if digests:
                sha = [hashlib.sha256(",".join([d for _, d in units]).encode()).hexdigest() for units in coded]
                plain = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(plain, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(size.sum()))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*rest.columns, lists, pa.array(decoded, pa.string())], names=[*names, "piece_ids", "decoded"])


def encode_decode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """df with `piece_ids` array<int> (no begin or end ids) and `decoded`, the library's decode of them.

    A null or empty text gives no ids and an empty decoded text. Texts of any length are encoded whole. Columns of
    df called piece_ids or decoded are replaced; every other column stays as it is. An empty table stays empty."""
    df = df.drop("piece_ids", "decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(lambda it: coded_batches(it, model_path, text, False), f"{fields}, piece_ids array<int>, decoded string")


def coded_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 digests of the ids and of the decoded text, made where they are encoded."""
    return docs.select("doc_id", "text").mapInArrow(
        lambda it: coded_batches(it, model_path, "text", True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
