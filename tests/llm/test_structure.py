"""Conversation repair, packing and Merkle proofs against brute force and on edge cases."""

import functools
import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelmill.llm import convrepair, merkle, packing
from labelmill.llm.queries import tokenizer

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- conversations -----------------------------------------------------------------------------------------------------
def damaged(rows):
    """{conv: rows in order} of the planned damage, row by row."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 0:
            continue
        text = "" if lot == 1 else "".join(c for c in text if c not in ".!?") if lot == 2 else text
        held += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def repaired(rows, wrong):
    """Cheapest, then least, edits by trying all of them row by row: (cost, edits, lines)."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {("", ""): (0, "", ())}  # (last role's initial, kind of form) -> least

    def inserted(now):
        for _ in range(3):
            for (end, _), (cost, text, lines) in list(now.items()):
                to = follow[end]
                x = (cost + 5, text + "I", (*lines, f"{name[to]}:"))
                now[to, ""] = min(now.get((to, ""), x), x)
        return now

    best = inserted(best)
    for (_, role, text), fault in zip(rows, wrong):
        after = {}

        def offer(end, x):
            after[end, ""] = min(after.get((end, ""), x), x)

        for (end, _), (cost, edits, lines) in best.items():
            offer(end, (cost + 2, edits + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            to = follow[end]
            offer(to, (cost + 1 + more, edits + "R", (*lines, f"{name[to]}:{text}")))
            if role[:1] == to or role[:1] == "s" and end == "":
                offer(role[:1], (cost + more, edits + "K", (*lines, f"{role}:{text}")))
        best = inserted(after)
    cost, edits, lines = min(v for (end, _), v in best.items() if end in ("", "a"))
    return cost, edits, "\n".join(lines)


def by_hand(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        wrong = faults(kept)
        turns = [t for t, _, _ in kept if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
        cost, edits, text = repaired(kept, wrong)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, sha(text),
        )
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(seed, n=120, most=12):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for t in range(rng.randint(0, most)):
            text = rng.choice(["Hi.", "Yes!", "no end", "", " \t", None, f"Text {rng.randint(0, 3)}?", "ends. ", "ends.\n", "é", f"{t}."])
            rows.append((c, rng.choice([t, t, t, t + rng.randint(0, 3), None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]), text))
    return rows


def check(spark, rows, piece=convrepair.PIECE):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", cost int, symbols string").repartition(3)
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in convrepair.repaired_conversations(df, piece).collect()}
    want = by_hand(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k
    return df


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_brute_force(spark, seed):
    check(spark, conversations(seed))


def test_long_conversations_are_cut_into_pieces(spark):
    """One conversation with a third of all rows; pieces of a few rows, so every way across their borders is met."""
    rng = random.Random(5)
    rows = conversations(3, 40) + [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", f"{t}.", f"{t}", ""])) for t in range(100, 500)]
    rows += [(8, None, "user", "same.")] * 60
    source = damaged(rows)
    df = check(spark, rows, 7)
    left = convrepair.damaged(df).filter("copies > 0")
    lines = convrepair.Repaired(left, 7).turns().orderBy("part", "piece", "place").collect()
    for conv in (7, 8, 3):
        want = repaired(source[conv], faults(source[conv]))[2]
        assert "\n".join(f"{r['role']}:{r['text']}" for r in lines if r["conv_id"] == conv) == want


def test_repair_of_empty_tables_and_lost_conversations(spark):
    assert convrepair.repaired_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = convrepair.repaired_conversations(spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)).first()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "", sha(""))


def test_grammar_gives_the_sequences_back():
    rng = random.Random(4)
    sequences = list(dict.fromkeys([bytes(rng.choice([2, 4, 8, 0]) for _ in range(rng.randint(1, 40))) for _ in range(200)] + [b"\x08" * 1000, b"\x02\x04" * 300]))
    rules, starts = convrepair.re_pair(sequences)

    def flat(s):
        return [s] if s <= convrepair.GONE else [y for x in rules[s - convrepair.GONE - 1] for y in flat(x)]

    assert [bytes(y for s in start for y in flat(s)) for start in starts] == sequences
    assert sum(map(len, starts)) + 2 * len(rules) < sum(map(len, sequences)) / 2
    pairs = {}
    for start in starts:
        for k, p in enumerate(itertools.pairwise(start)):
            pairs.setdefault(p, []).append(k)
    assert all(len(at) < 2 or p[0] == p[1] for p, at in pairs.items())


# --- Merkle manifest ---------------------------------------------------------------------------------------------------
def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(nodes):
    """All levels of the tree over some digests."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path_of(tree, i):
    out = []
    for nodes in tree[:-1]:
        out.append((nodes[i ^ 1] if (i ^ 1) < len(nodes) else None, i % 2))
        i //= 2
    return out


def fold(node, path):
    for other, right in path:
        node = sha(node if other is None else other + node if right else node + other)
    return node


def manifest_by_hand(rows):
    """{leaf and doc_id: results} of (doc_id, source, lang, n_chars, text); equal rows give several."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree_of([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for k, g in enumerate(order):
        for i, (_, _, leaf, (doc_id, source, lang, n_chars, text)) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = path_of(trees[g], i) + path_of(top, k)
            hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            end = fold(leaf_of(doc_id, source, lang, n_chars + 1, text) if hit else leaf, path)
            out.append((doc_id, leaf, trees[g][-1][0], root, sha("".join(s for s, _ in path if s)), end, end == root))
    return out


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def check_manifest(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS + ", root string, g string").repartition(3)
    key = lambda r: tuple((v is not None, v) for v in r)
    got = sorted((tuple(r[c] for c in PROOF) for r in merkle.document_proofs(df).collect()), key=key)
    assert got == sorted(manifest_by_hand(rows), key=key)


def documents(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((rng.choice([None, *range(2000)]), rng.choice(["web", "é", None]), lang, rng.choice([None, 5, 2**63 - 1, 0]), rng.choice([None, "", "a", "x:y", "long " * 50])))
    return rows + rows[:5]


@pytest.mark.parametrize("sizes", [{"en": 700, None: 3, "": 1, "é": 2, "z": 257, "Z": 256}, {"en": 1}, {None: 2, "b": 1}, {str(k): 1 + k % 3 for k in range(300)}])
def test_proofs_equal_the_whole_trees(spark, sizes):
    check_manifest(spark, documents(1, sizes))


def test_proofs_of_an_empty_table(spark):
    assert merkle.document_proofs(spark.createDataFrame([], DOCS)).collect() == []


def test_stored_levels_are_every_eighth_and_proofs_lead_to_the_root(spark):
    leaves = spark.range(70_000).select(F.lit("a").alias("lang"), F.col("id").alias("key"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"), F.lit(None).cast("binary").alias("other"))
    manifest = merkle.Manifest(leaves, "lang")
    assert [s.agg(F.sum(F.octet_length("nodes"))).first()[0] // 32 for s in manifest.groups.stored] == [70_000, 274, 2]
    tree = tree_of([sha(str(i)) for i in range(70_000)])
    rows = manifest.proofs().filter("key % 9973 = 0 or key = 69999").collect()
    assert len(rows) == 9
    for r in rows:
        assert r["root"] == r["subroot"] == tree[-1][0]
        assert merkle.folded(r["leaf"].encode(), bytes(r["path"])).decode() == r["root"]
        assert [s.decode() or None for _, s in merkle.steps(bytes(r["path"]))] == [s for s, _ in path_of(tree, r["key"])]


# --- packing -----------------------------------------------------------------------------------------------------------
BPE = "byte_bpe_50k.json"


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(BPE))


def ids_of(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def odd_texts():
    rng = random.Random(2)
    bits = ["a", "paé", "été", "à", "'s", "'ll", "don't", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\u3000", "\u2028", "\u0085", "\x1c", "\x00", "!", "...", "x,y", "12.5", "日本", "ß", "<|endoftext|>", "<|", "_", "-", "\r\n", "É", "ǅ", "٣", "e\u0301"]
    return [None, "", " ", "word", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(600))]


def test_ids_equal_the_library():
    """Texts of odd white space, signs and special tokens, with the memory emptied on the way."""
    texts, coder = odd_texts(), packing.Pieces(tokenizer(BPE))
    coder.REMEMBERED, coder.TOGETHER = 300, 500
    got = []
    for flat, count in coder.encode(pa.array(texts)):
        got += [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]
    assert got == [ids_of(t) for t in texts]


def check_packing(rows, docs, room):
    """Pieces, offsets and room of packed documents {doc_id: texts}."""
    seen = sorted((r["doc_id"] is not None, r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = []
    for doc_id, texts in docs.items():
        for t in texts:
            ids = ids_of(t)
            first = (len(ids) - 1) % room + 1
            cuts = [0, *range(first, len(ids) + 1, room)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                want.append((doc_id is not None, doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert seen == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


def test_packing_equals_brute_force_pieces(spark):
    texts = [*odd_texts()[:150], "long text " * 700, "z" * 9000, "word " * 63]
    rows = [(k if k else None, t, 1, "x") for k, t in enumerate(texts)] + [(3, texts[3], 2, "y")] * 4
    df = spark.createDataFrame(rows, "doc_id int, text string, rid int, sequence_id string").repartition(3)
    docs = {}
    for doc_id, t, _, _ in rows:
        docs.setdefault(doc_id, []).append(t)
    packed = packing.packed(df, tokenizer(BPE), room=64, ids=True).cache()
    used = check_packing(packed.collect(), docs, 64)
    total = sum(len(ids_of(t)) for ts in docs.values() for t in ts)
    assert -(-total // 64) <= used <= -(-total // 64) * 1.02 + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.token_sequences(packed).collect()}
    for r in packed.collect():
        part = whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    packed.unpersist()


def test_packing_of_empty_tables(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), tokenizer(BPE)).collect() == []
    row = packing.packed(spark.createDataFrame([(1, None)], "doc_id long, text string"), tokenizer(BPE)).collect()
    assert [(r["length"], r["offset"], r["ids_crc32"]) for r in row] == [(1, 0, zlib.crc32(bytes(4)))]


def fewest(lengths, room):
    """The least number of bins, by trying."""
    best = len(lengths)
    order = sorted(lengths, reverse=True)

    def place(k, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if k == len(order):
            best = len(fills)
            return
        for b in range(len(fills)):
            if fills[b] + order[k] <= room and fills[b] not in fills[:b]:
                place(k + 1, [*fills[:b], fills[b] + order[k], *fills[b + 1 :]])
        place(k + 1, [*fills, order[k]])

    place(0, [])
    return best


def test_evolution_finds_the_fewest_bins():
    """Small instances against exhaustive search; the bound is never above, and children keep every piece once."""
    rng = np.random.default_rng(3)
    for seed in range(60):
        lengths = rng.integers(1, [40, 90, 50][seed % 3], 11) + [0, 10, 20][seed % 3]
        island = packing.Island(lengths.astype(np.int64), 100, [seed])
        want = fewest(lengths.tolist(), 100)
        assert island.bound <= want
        island.evolve()
        for bins, fills in island.members:
            assert (np.bincount(bins, lengths) == fills).all() and fills.max() <= 100 and fills.min() > 0
        assert len(island.members[0][1]) == want


def test_evolution_beats_best_fit():
    """Triples that fill a bin exactly, where falling best fit wastes bins."""
    rng = np.random.default_rng(5)
    for seed in range(6):
        a, b = rng.integers(380, 490, 60), rng.integers(260, 300, 60)
        lengths = np.concatenate([a, b, 1000 - a - b])
        fills: list = []
        packing.best_fit(np.argsort(-lengths, kind="stable").tolist(), lengths.tolist(), 1000, np.zeros(180, np.int32), fills)
        island = packing.Island(lengths, 1000, [seed])
        island.evolve()
        assert len(fills) >= 68 and len(island.members[0][1]) <= 62
