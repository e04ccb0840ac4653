"""Cases of the findings of round 4."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelmill.operators import coco, ordering, rasters, runs
from labelmill.plans import mask_queries, registry

from test_masks import flat_runs, images

DATA = "/root/testdata/sf0.001"


def striped(h=9, w=13):
    """Rows of many runs each, and a column that is cut in the middle."""
    stripes = np.zeros((h, w), bool)
    stripes[:, ::2] = True
    cut = np.ones((h, w), bool)
    cut[4, 2:9] = False
    return [stripes, np.kron(np.eye(4, 6, dtype=bool), np.ones((2, 2), bool))[:h, :w], cut, ~stripes]


def sides(spark):
    """Truth and detections in two images; a null mask, an empty one, crowds, and distances that differ by image."""
    def frame(masks, key, last):
        rows = [(i % 2, 1, i, None if i == 9 else flat_runs(m), m.shape[1], *((int(i % 5 == 0),) if key == "gt_id" else (i / 40,))) for i, m in enumerate(masks)]
        return spark.createDataFrame(rows, f"image_id int, category_id int, {key} long, runs array<bigint>, width int, {last}").withColumn("near", F.col("image_id") + 1)

    return frame(images(2, 40) + striped(), "gt_id", "iscrowd int"), frame(images(3, 44) + striped(), "det_id", "score double")


@pytest.mark.parametrize("boundary", [False, True])
@pytest.mark.parametrize("least", [0.1, 0.5])
def test_close_pairs_are_the_pairs_that_reach_the_least_value(spark, boundary, least):
    gt, det = sides(spark)
    near = F.col("near") if boundary else None
    got = runs.close_pairs(runs.measured(gt), runs.measured(det), least, distance=near)
    full = lambda df: runs.with_boxes(runs.with_boundary(df, F.col("near")))
    want = runs.mask_pairs(full(gt), full(det), boundary=boundary).filter(F.col("v") >= least)
    key = lambda df: {(r["image_id"], r["gt_id"], r["det_id"]): (r["v"], r["crowd"], r["score"]) for r in df.collect()}
    assert key(got) == key(want) and len(key(got)) == got.count() > 20
    areas = {r["gt_id"]: r["n"] for r in gt.select("gt_id", runs.area(F.col("runs")).alias("n")).collect()}
    assert all(r["area"] == areas[r["gt_id"]] for r in got.collect())


def test_masks_are_measured_as_their_runs_say(spark):
    gt, _ = sides(spark)
    key = lambda df: {r["gt_id"]: (r["area"], *[r[c] for c in ("x0", "y0", "x1", "y1")]) for r in df.collect()}
    got = key(runs.measured(gt))
    assert got == key(runs.with_boxes(gt).withColumn("area", runs.area(F.col("runs"))))
    assert got[9] == (None,) * 5 and got[0] == (0, None, None, None, None)


def test_shapes_become_the_runs_that_the_fixture_has(spark):
    for name, key in (("gt_mask", "gt_id"), ("det_mask", "det_id")):
        want = {(r["image_id"], r[key]): (r["runs"], r["area"], r["x0"], r["y1"]) for r in mask_queries.masks(spark, DATA, name).collect()}
        shapes = mask_queries._shapes(spark, DATA, name).collect()
        values, n = mask_queries._runs_of(pa.array([r["shape"] for r in shapes], pa.list_(pa.int64())))
        flat = np.split(values, np.cumsum(n)[:-1])
        assert {(r["image_id"], r[key]): (v.tolist(), r["area"], r["x0"], r["y1"]) for r, v in zip(shapes, flat)} == want


@pytest.mark.parametrize("name", ["coco_segm_summary", "coco_boundary_by_category"])
def test_masks_become_runs_once_for_their_size_and_once_for_their_pairs(spark, monkeypatch, name):
    """Ranks, pairs and range partitions read what is landed; they make no mask or band again."""
    seen = {}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(coco, "matched", lambda pairs, det, gt, real=coco.matched, **k: seen.update(pairs=plan(pairs), det=plan(det), gt=plan(gt)) or real(pairs, det, gt, **k))
    monkeypatch.setattr(ordering, "ranged", lambda df, *k, real=ordering.ranged: seen.update(ranged=plan(df)) or real(df, *k))
    registry.QUERIES[name](spark, DATA)
    assert {k: v.count("MapInArrow") for k, v in seen.items()} == {"pairs": 1, "det": 0, "gt": 0, "ranged": 0}
    assert seen["pairs"].count("Exchange hashpartitioning(") == 2 and seen["pairs"].count("REPARTITION_BY_NUM") == 2
    assert "Exchange" not in seen["ranged"]


def test_categories_without_a_number(spark):
    """Names as categories, one that is null, one without truth, one without detections; parts of two rows."""
    rng = np.random.default_rng(5)
    rows = [(int(i), c, int(i), float(rng.integers(0, 9)) / 9, int(i % 3 + 1), int(rng.integers(0, 4)), 0) for i in range(60) for c in ("cat", None, "dog")]
    found = spark.createDataFrame([(*r[:6], int(rng.integers(0, 4)) & ~r[5]) for r in rows], "image_id int, category_id string, det_id long, score double, rank int, tp long, ignored long")
    n_gt = spark.createDataFrame([("cat", "all", 50), ("owl", "all", 7)], "category_id string, range string, n_gt long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(r["category_id"], r["t"]): (r["n_gt"], r["ap"], r["ar_1"], r["ar_2"]) for r in coco.by_category(found, n_gt, (0.5, 0.75), (1, 2), ("all",), 11).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(got) == [("cat", 0.5), ("cat", 0.75), ("owl", 0.5), ("owl", 0.75)]
    own = sorted((r for r in found.collect() if r["category_id"] == "cat"), key=lambda r: (-r["score"], r["image_id"], r["det_id"]))
    for i, t in enumerate((0.5, 0.75)):
        assert got["owl", t] == (7, 0.0, 0.0, 0.0)
        hits = counted = 0
        best = [0.0] * 11
        for r in own:
            hits, counted = hits + (r["tp"] >> i & 1), counted + 1 - (r["ignored"] >> i & 1)
            if r["tp"] >> i & 1:
                q = int(hits / 50 * 10 + 1e-9)
                best[: q + 1] = [max(b, hits / counted) for b in best[: q + 1]]
        recall = [sum(r["tp"] >> i & 1 for r in own if r["rank"] <= m) / 50 for m in (1, 2)]
        assert got["cat", t] == (50, pytest.approx(sum(best) / 11), *recall)


def test_band_overlaps_equal_the_bands_of_pixels(spark):
    """Images of several batches, ignored and null labels, a place given twice, one label in both rasters or in one."""
    rng = np.random.default_rng(7)
    rows = []
    for image in range(7):
        h, w = (20, 30) if image == 3 else (5 + image, 9)
        a, b = (np.kron(rng.integers(0, 3, (h // 3 + 1, w // 4 + 1)), np.ones((3, 4), int))[:h, :w] for _ in range(2))
        b[rng.random(b.shape) < 0.05] = 255
        rows += [(image, y, x, None if (image, y, x) == (2, 1, 1) else int(a[y, x]), int(b[y, x])) for y in range(h) for x in range(w)]
    schema = "image_id long, y int, x int, gt int, pred long"
    px = spark.createDataFrame(rows, schema)
    want = {}
    for d in (1, 2):
        bands = [rasters.boundary_band(px.filter(f"{c} <> 255").select("image_id", "y", "x", F.col(c).alias("label")), ["image_id", "label"], d).collect() for c in ("gt", "pred")]
        gt, pred = ({(r["image_id"], r["label"], r["y"], r["x"]) for r in b} for b in bands)
        want[d] = {k: tuple(sum(p[:2] == k for p in s) for s in (gt, pred, gt & pred)) for k in {p[:2] for p in gt | pred}}
    twice = spark.createDataFrame(rows + rows[:9], schema).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for d in (1, 2):
            got = rasters.band_overlaps(twice, d)
            assert {(r["image_id"], r["label"]): (r["gt_n"], r["pred_n"], r["n"]) for r in got.collect()} == want[d]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bands_of_rasters_are_made_once_and_no_pixel_is_joined(spark, monkeypatch):
    from labelmill.plans import box_queries

    seen, landed = [], []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(box_queries, "land", lambda df, real=box_queries.land: landed.append(plan(df)) or real(df))
    monkeypatch.setattr(box_queries.matching, "greedy_match", lambda pairs, det, *k, real=box_queries.matching.greedy_match: seen.extend([plan(pairs), plan(det)]) or real(pairs, det, *k))
    registry.QUERIES["boundary_ap"](spark, DATA)
    assert len(landed) == 1 and landed[0].count("Exchange hashpartitioning(") == 1 and "SortMergeJoin" not in landed[0]  # the orders
    assert not any(w in p for p in seen for w in ("Window", "Join", "Exchange"))
