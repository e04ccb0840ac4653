"""Near-duplicates, vector dedup, neighbours and components against brute force and on edge cases."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelmill.llm import ann, neardup, vecdedup
from labelmill.llm import components as components_
from labelmill.llm.common import keyed_join
from labelmill.llm.components import connected_components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 4)))
    base = [[word() for _ in range(60)] for _ in range(4)]
    out = [None, "", "  \t\n", "One", "one", "one two", "ONE\x0bTWO", "é É", "a b c", "a b c", "x" * 50_000, " ".join(["same"] * 500)]
    for b in base:
        out += [" ".join(b), " ".join(b).upper()]
        for _ in range(15):
            v = list(b)
            for _ in range(rng.randint(1, 5)):
                v[rng.randrange(len(v))] = word()
            out.append(" ".join(v))
    out += [" ".join(base[0] + [word() for _ in range(rng.randint(1, 120))]) for _ in range(30)]
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rows = [(i + 10, t, "x", i) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, cluster string, kept int").repartition(3)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, width, percent).collect()}
    sets = {i: shingles(t, width) for i, t, _, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())


def test_large_groups_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "POSTING_BLOCK", 4)
    monkeypatch.setattr(neardup, "SET_BLOCK", 3)
    test_near_duplicates_equal_brute_force(spark, 3, 85)


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and all(r["kept"] for r in got)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]


@pytest.mark.parametrize("texts", [["a b"], ["a b c"], ["a b", "x" * 1_100_000 + " y"], ["a b c", "x" * 1_100_000]])
def test_chunks_of_fewer_words_than_the_width(spark, texts):
    rows = [(i, t) for i, t in enumerate([*texts, *texts])]
    for df in (spark.createDataFrame(rows, "doc_id long, text string").repartition(1), spark.createDataFrame(rows[: len(texts)], "doc_id long, text string").coalesce(1)):
        got = neardup.near_duplicates(df, 5, 80).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {r["doc_id"]: (1, r["doc_id"] % len(texts)) for r in df.collect()}


def test_frequent_keys_are_joined_like_others(spark):
    rows = spark.range(200).select(F.when(F.col("id") % 2 == 0, "often").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id")
    table = rows.select("k").distinct().filter("k <> 'k7'").withColumn("w", F.length("k"))
    want = sorted(map(tuple, rows.join(table, ["k"]).select("k", "id", "w").collect()))
    for share in (2, 4, 1000):
        assert sorted(map(tuple, keyed_join(rows, table, ["k"], share).select("k", "id", "w").collect())) == want
    assert keyed_join(rows.limit(0), table, ["k"]).count() == 0


@pytest.mark.parametrize("share", [1000, 4])
def test_components_of_chains_and_stars(spark, monkeypatch, share):
    monkeypatch.setattr(components_, "HUBS", share)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    rows = [(None, 0, [1.0] * 8), (1, None, [1.0] * 8), (2, 0, None), (3, 0, [0.0] * 8), (4, 0, [float("nan")] + [1.0] * 7), (5, 0, [None] + [1.0] * 7), (6, 0, [float("inf")] + [1.0] * 7)]
    k = 20
    for label in (0, 1):
        for _ in range(12):
            c = rng.normal(size=8)
            for _ in range(rng.integers(1, 12)):
                rows.append((k, label, (c + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.25])).astype(np.float32).tolist()))
                k += 1
    rows.append((k, 0, rows[-1][2]))
    return rows


def test_vector_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "GROUP_BLOCK", 5)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label long, embedding array<float>, n int").repartition(3)
    got = vecdedup.linked_vectors(df).collect()
    assert len(got) == len(rows)
    good = {r[0]: (r[1], np.array(r[2]) / np.linalg.norm(r[2])) for r in rows if r[0] and r[0] >= 20}
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and good[a][1] @ good[b][1] >= 0.93]
    want = components(good, links)
    for r in got:
        if r["vec_id"] in good:
            n = sum(r["vec_id"] in pair for pair in links)
            assert (r["n_links"], r["component_id"], r["kept"]) == (n, want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
    assert vecdedup.linked_vectors(df.limit(0)).count() == 0


def test_vectors_of_several_lengths(spark):
    rows = [(i, 0, [1.0, 0.1 * i] + [0.0] * (i % 3)) for i in range(12)]
    got = {r["vec_id"]: r for r in vecdedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").repartition(2)).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    want = components(unit, links)
    assert links and {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (sum(i in x for x in links), want[i]) for i in unit}
    with pytest.raises(ValueError):
        ann.nearest(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), F.lit(True))


def test_rows_that_repeat_a_key_have_links_of_their_own(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [1.0, 0.01]), (3, 0, [0.01, 1.0]), (1, 0, [1.0, 0.0]), (4, 0, [-1.0, 0.0])]
    got = vecdedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 0, 4)]


def test_passes_find_all_links_of_a_large_label(spark):
    """4,000 vectors of one label, half of them in a cone of cosine 0.9 to its axis: the components of all true links."""
    rng = np.random.default_rng(8)
    axis = rng.normal(size=32)
    axis /= np.linalg.norm(axis)
    side = rng.normal(size=(2000, 32))
    side -= (side @ axis)[:, None] * axis
    cone = 0.9 * axis + 0.436 * side / np.linalg.norm(side, axis=1)[:, None]
    base = rng.normal(size=(1000, 32))
    near = base + 0.05 * np.linalg.norm(base, axis=1)[:, None] * rng.normal(size=(1000, 32))
    x = np.concatenate([cone, base, near])
    got = {r["vec_id"]: r for r in vecdedup.linked_vectors(spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = np.triu(unit @ unit.T >= 0.93, 1)
    want = components(range(len(x)), np.argwhere(link).tolist())
    true = (link | link.T).sum(axis=1)
    assert link.sum() > 900
    found = sum(got[i]["n_links"] for i in want)
    assert all(got[i]["n_links"] <= true[i] for i in want) and found / true.sum() >= 0.99
    assert sum(got[i]["component_id"] == want[i] for i in want) / len(want) >= 0.99


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in df.collect()}
    ids, x = np.array(list(rows)), np.array(list(rows.values()))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in ids[ids % 20 == 0].tolist():
        s = np.where(ids == q, -np.inf, x @ rows[q])
        hit += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9


def test_neighbours(spark):
    rows = [(r[0], r[2]) for r in vectors()] + [(900 + i, [0.5] * 8) for i in range(30)]
    df = spark.createDataFrame([(*r, 0.0) for r in rows], "vec_id long, embedding array<float>, score double").repartition(3)
    ask = F.col("vec_id") % 5 == 0
    got = ann.nearest(df, ask, k=7).collect()
    good = {r[0]: np.array(r[1], dtype=np.float32).astype(float) for r in rows if r[0] and r[0] >= 20 or r[0] == 1}
    hit = n = 0
    for q in (i for i in good if i % 5 == 0):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1)) and len(mine) == 7
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        for r in mine:
            assert r["score"] == pytest.approx(good[q] @ good[r["vec_id"]], abs=1e-12) and r["vec_id"] != q
        best = sorted((-(good[q] @ v), i) for i, v in good.items() if i != q)[:7]
        hit += len({round(-s, 9) for s, _ in best} & {round(r["score"], 9) for r in mine})
        n += len({round(-s, 9) for s, _ in best})
    assert hit / n >= 0.9
    assert ann.nearest(df.limit(0), ask).count() == 0
    few = ann.nearest(df.filter("vec_id in (20, 21, 25)"), ask, k=20).collect()
    assert len(few) == 4


@pytest.mark.parametrize("equal", [True, False])
def test_ties_of_a_leaf_take_bounded_memory(equal):
    """2,000 rows that all score alike, as copies of one vector or as different ones, asked by 300 of them."""
    n, asks, k = 2000, 300, 5
    x = np.zeros((n, 64))
    x[:, 0] = 1.0
    if not equal:
        x[np.arange(n), 1 + np.arange(n) % 40] = np.arange(n) // 40
    ask = np.zeros((asks, 64))
    ask[:, 0] = 1.0
    ids = np.random.default_rng(1).permutation(n)
    both = np.concatenate([x, ask])
    batch = pa.RecordBatch.from_pydict({
        "leaf": np.zeros(n + asks, dtype=np.int64), "query": np.repeat([0, 1], [n, asks]), "id": np.concatenate([ids, np.arange(asks)]),
        "v": pa.FixedSizeListArray.from_arrays(both.ravel(), 64).cast(pa.list_(pa.float64())),
    })
    tracemalloc.start()
    out = pa.Table.from_batches(ann.best_batches([batch], k, ["leaf"])).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((r["query_id"], r["vec_id"]) for r in out) == [(q, v) for q in range(asks) for v in [i for i in range(k + 1) if i != q][:k]]
    assert all(r["score"] == 1.0 for r in out) and peak < 150e6
