"""Run algebra, matching in rounds, levels of cells and polygon clipping against brute force on pixels and pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.functions import geometry as G
from labelmill.operators import boxes, matching, rasters, runs


def flat_runs(mask):
    """Packed runs of a boolean image, row by row."""
    out = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
        out += [int(y * mask.shape[1] + x) for x in edge]
    return out


def places(flat):
    return {p for a, b in zip(flat[0::2], flat[1::2]) for p in range(a, b)}


def images(seed, n, h=9, w=13):
    rng = np.random.default_rng(seed)
    out = [np.zeros((h, w), bool), np.ones((h, w), bool)]
    for _ in range(n - 2):
        m = np.zeros((h, w), bool)
        for _ in range(rng.integers(1, 4)):
            y, x = rng.integers(0, h - 1), rng.integers(0, w - 1)
            m[y : y + rng.integers(1, h), x : x + rng.integers(1, w)] = True
        for _ in range(rng.integers(0, 4)):
            m[rng.integers(0, h), rng.integers(0, w)] ^= True
        out.append(m)
    return out


def band_of(mask, d):
    padded = np.pad(mask, d)
    full = np.ones_like(mask)
    for dy in range(2 * d + 1):
        for dx in range(2 * d + 1):
            full &= padded[dy : dy + mask.shape[0], dx : dx + mask.shape[1]]
    return mask & ~full


def test_boundaries_and_boxes_equal_pixels(spark):
    masks = images(1, 60)
    rows = [(i, flat_runs(m), m.shape[1], 1 + i % 4) for i, m in enumerate(masks)]
    df = spark.createDataFrame(rows, "k int, runs array<bigint>, width bigint, d int").repartition(3)
    got = runs.with_boundary(runs.with_boxes(df), F.col("d")).withColumn("area", runs.area(F.col("runs"))).collect()
    assert len(got) == len(masks)
    for r in got:
        m = masks[r["k"]]
        assert places(r["band"]) == places(flat_runs(band_of(m, r["d"])))
        assert r["area"] == m.sum()
        ys, xs = np.nonzero(m)
        assert tuple(r[c] for c in boxes.XYXY) == ((xs.min(), ys.min(), xs.max() + 1, ys.max() + 1) if len(ys) else (None,) * 4)


@pytest.mark.parametrize("boundary", [False, True])
def test_mask_pairs_equal_pixels(spark, boundary):
    gt, det = images(2, 14), images(3, 16)

    def frame(masks, key, last):
        rows = [(0, 1, i, flat_runs(m), 13, i % 5 == 0 if key == "gt_id" else 0.5) for i, m in enumerate(masks)]
        df = spark.createDataFrame([(*r[:5], int(r[5]) if key == "gt_id" else r[5]) for r in rows], f"image_id int, category_id int, {key} long, runs array<bigint>, width bigint, {last}")
        return runs.with_boundary(runs.with_boxes(df), 1)

    got = {(r["gt_id"], r["det_id"]): (r["v"], r["crowd"]) for r in runs.mask_pairs(frame(gt, "gt_id", "iscrowd int"), frame(det, "det_id", "score double"), boundary=boundary, grid=4.0).collect()}
    for i, g in enumerate(gt):
        for j, d in enumerate(det):
            both = (g & d).sum()
            if not both:
                assert (i, j) not in got
                continue
            iou = lambda a, b, crowd=i % 5 == 0: (a & b).sum() / (b.sum() if crowd else (a | b).sum())
            want = min(iou(g, d), iou(band_of(g, 1), band_of(d, 1))) if boundary else iou(g, d)
            assert got[i, j] == (pytest.approx(want, abs=1e-9), i % 5 == 0)


def test_packing_and_union_of_runs(spark):
    rng = random.Random(4)
    rows = [(k, y, x, x + rng.randint(1, 5)) for k in range(4) for y in range(5) for x in (rng.randint(0, 20) for _ in range(6))]
    df = spark.createDataFrame(rows, "k int, y long, x0 long, x1 long")
    united = runs.union_runs(df, ["k"])
    cells = {(k, y, x) for k, y, a, b in rows for x in range(a, b)}
    got = united.collect()
    assert {(r["k"], r["y"], x) for r in got for x in range(r["x0"], r["x1"])} == cells
    assert sum(r["x1"] - r["x0"] for r in got) == len(cells)
    one = {r["k"]: r for r in runs.packed(united, ["k"], F.lit(30)).collect()}
    assert {(k, p // 30, p % 30) for k, r in one.items() for p in places(r["runs"])} == cells


def test_run_lengths_decode(spark):
    rows = [(1, ([3, 4], [2, 3, 0, 1, 6])), (2, ([3, 4], [0, 12])), (3, ([3, 4], [12])), (4, None), (5, ([3, 4], []))]
    got = rasters.rle_decode(spark.createDataFrame(rows, "k int, rle struct<size:array<int>,counts:array<bigint>>")).collect()
    assert sorted((r["k"], r["y"] + 3 * r["x"]) for r in got) == [(1, p) for p in (2, 3, 4, 5)] + [(2, p) for p in range(12)]


@pytest.mark.parametrize("dense", [0, 1500, 10**6])
def test_levels_of_cells_find_all_pairs(spark, dense):
    """Boxes from a point to the whole image, in three images; at most four cells a box and level."""
    rng = random.Random(8)
    make = lambda n: [(rng.randrange(3), i, x, y, x + rng.choice([0.5, 3.0, 20.0, 200.0, 900.0]), y + rng.choice([0.5, 5.0, 60.0, 500.0])) for i in range(n) for x, y in [(rng.uniform(-50, 900), rng.uniform(-50, 900))]]
    schema = "image_id int, k int, x0 double, y0 double, x1 double, y1 double"
    a, b = (spark.createDataFrame(make(120), schema) for _ in range(2))
    got = sorted((r["a_k"], r["b_k"]) for r in boxes.overlapping_pairs(a, b, ["image_id"], 4.0, dense).collect())
    every = boxes.pairs(a, b, ["image_id"]).filter(G.intersection(G.columns("a_"), G.columns("b_")) > 0)
    assert got == sorted((r["a_k"], r["b_k"]) for r in every.collect())
    placed = boxes._cells(a.select("k", *[F.col(c).alias("a_" + c) for c in boxes.XYXY]), "a_", F.lit(4.0) * F.pow(F.lit(2.0), boxes._level("a_", 4.0)))
    assert placed.groupBy("k").count().agg(F.max("count")).first()[0] <= 4


def greedy(pairs, det, t):
    """{det: (gt, ignored)} of (det, gt, v, crowd, ignore) pairs, detections by falling score."""
    taken, out = set(), {}
    for d, _ in sorted(det, key=lambda x: (-x[1], x[0])):
        free = [(ignore, -v, g, crowd) for k, g, v, crowd, ignore in pairs if k == d and v >= t and (crowd or g not in taken)]
        if free:
            ignore, _, g, crowd = min(free)
            out[d] = (g, ignore)
            taken |= set() if crowd else {g}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_the_greedy_order(spark, seed):
    """Dense candidates with equal scores and values, crowds and ignored truths; chains that take many rounds."""
    rng = random.Random(seed)
    rows, scores = [], {}
    for image in range(6):
        crowd = {g: rng.random() < 0.15 for g in range(12)}
        ignore = {g: crowd[g] or rng.random() < 0.2 for g in range(12)}
        for d in range(25):
            scores[image, d] = rng.randrange(6) / 6
            rows += [(image, 0, d, scores[image, d], g, rng.randrange(10, 20) / 20, crowd[g], ignore[g]) for g in range(12) if rng.random() < 0.5]
    rows += [(9, 0, d, 1 - d / 100, g, 0.9 if g == d else 0.95 if g == d - 1 else 0.0, False, False) for d in range(30) for g in (d - 1, d) if g >= 0]
    scores |= {(9, d): 1 - d / 100 for d in range(30)}
    pairs = spark.createDataFrame(rows, "image_id int, category_id int, det_id long, score double, gt_id long, v double, crowd boolean, ignore boolean").repartition(4)
    det = spark.createDataFrame([(i, 0, d, s) for (i, d), s in scores.items()], "image_id int, category_id int, det_id long, score double")
    got = matching.greedy_match(pairs, det, (0.5, 0.75, 0.9)).collect()
    assert len(got) == 3 * len(scores)
    for t in (0.5, 0.75, 0.9):
        for image in {i for i, _ in scores}:
            want = greedy([(r[2], *r[4:]) for r in rows if r[0] == image], [(d, s) for (i, d), s in scores.items() if i == image], t)
            assert {r["det_id"]: (r["gt_id"], r["ignored"]) for r in got if r["t"] == t and r["image_id"] == image and r["gt_id"] is not None} == want


def test_polygons_are_clipped(spark):
    """Areas against a fine grid of points, for convex, concave, outer, enclosing and degenerate polygons."""
    rng = random.Random(3)
    shapes = [[0, 0, 10, 0, 10, 10, 0, 10], [2, 2, 4, 2, 4, 4], [-5, -5, 30, -5, 30, 30, -5, 30], [20, 20, 30, 20, 30, 30], [1, 1, 5, 5], [], [3, 3], [0, 0, 12, 6, 0, 12, 6, 6], [5, 0, 5, 10, 5, 20], [3, 3, 9, 3, 9, 8, 3, 8, 3, 3]]
    for _ in range(12):
        cx, cy = rng.uniform(0, 12), rng.uniform(0, 12)
        ring = [(cx + rng.uniform(1, 9) * np.cos(a), cy + rng.uniform(1, 9) * np.sin(a)) for a in np.linspace(0, 6.28, rng.randint(3, 9), endpoint=False)]
        shapes.append([float(v) for p in ring for v in p])
    df = spark.createDataFrame([(i, [float(v) for v in s], [[float(v) for v in s], [0.0, 0.0, 1.0, 0.0, 0.0, 1.0]]) for i, s in enumerate(shapes)], "k int, p array<double>, parts array<array<double>>")
    window = [F.lit(v) for v in (3.0, 2.0, 11.0, 9.0)]
    rows = df.select("k", G.clip_polygon(F.col("p"), *window).alias("c"), G.clip_polygons(F.col("parts"), *window).alias("parts")).withColumn("area", G.polygon_area(F.col("c"))).collect()
    step = 0.02
    xs, ys = np.meshgrid(np.arange(3 + step / 2, 11, step), np.arange(2 + step / 2, 9, step))
    for r in rows:
        p = np.array(shapes[r["k"]], float).reshape(-1, 2)
        inside = np.zeros(xs.shape, bool)
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, 0)) if len(p) >= 3 else ():
            if ay != by:
                inside ^= ((ay > ys) != (by > ys)) & (xs < ax + (ys - ay) * (bx - ax) / (by - ay))
        assert r["area"] == pytest.approx(inside.sum() * step * step, abs=0.15), r["k"]
        flat = np.array(r["c"]).reshape(-1, 2)
        assert (flat >= -1e-9).all() and (flat <= [8 + 1e-9, 7 + 1e-9]).all() if len(flat) else r["c"] == []
        assert r["parts"] == ([r["c"]] if r["c"] else [])
