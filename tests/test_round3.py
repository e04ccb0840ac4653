"""Cases of the findings of round 3."""

from pyspark.sql import functions as F

from labelmill.functions import geometry as G
from labelmill.operators import decode, rasters, sampling
from labelmill.operators import runs as sweeps


def test_clipped_corner_is_not_outside_by_rounding(spark):
    points = F.array(*[F.lit(float(v)) for v in (303, 82, 275, 82, 303, 25)])
    cut = spark.range(1).select(G.clip_polygon(points, *[F.lit(float(v)) for v in (100, 80, 300, 250)]).alias("p")).first()["p"]
    assert len(cut) >= 6 and min(cut) >= 0 and max(cut[0::2]) <= 200 and max(cut[1::2]) <= 170


def test_crops_without_labelled_pixels_can_be_left_out(spark):
    px = spark.createDataFrame([(1, 0, 0, 255), (2, 0, 0, 3), (2, 0, 5, 255)], "image_id long, y long, x long, label long")
    tries = spark.createDataFrame([(i, k, 4 * k, 0, 4 * k + 4, 4) for i in (1, 2) for k in (0, 1)], "image_id long, attempt long, cx0 long, cy0 long, cx1 long, cy1 long")
    found = lambda **how: {(r["image_id"], r["attempt"]) for r in sampling.accepted_crop(px, tries, 0.45, **how).collect()}
    assert found() == {(1, 1), (2, 1)}
    assert found(labelled=True) == {(2, 0)}


def exchanges(df):
    """What the rows of each shuffle of a plan are dealt by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_pixels_are_shuffled_by_image_alone(spark):
    cls = spark.createDataFrame([(1, q, c, float(q - c)) for q in range(2) for c in range(2)], "image_id long, q long, c long, logit double")
    mask = spark.createDataFrame([(1, q, 0, x, float(x - q)) for q in range(3) for x in range(3)], "image_id long, q long, y long, x long, logit double")
    things = spark.createDataFrame([(0, 1), (1, 0)], "c long, isthing int")
    found = [decode.semantic_labels(cls, mask, range(2), 9), decode.argmax_label(decode.semantic_scores(cls, mask, range(2)), 9), *decode.panoptic_merge(cls, mask, things, 0.25, 0.1)]
    for df in found:
        assert df.count() > 0 and not [e for e in exchanges(df) if ", y#" in e.split("),")[0]]
    assert found[0].count() == 3 and found[2].count() == 3  # a query of the masks without classes takes no part, its pixels stay


def test_losses_of_masks_need_no_join(spark):
    from labelmill.plans import registry

    assert len(exchanges(registry.QUERIES["mask_losses"](spark, "/root/testdata/sf0.001"))) == 1


def test_crossings_of_polygons_are_not_shuffled(spark):
    """A square with a hole as two polygons of equal keys, one without a place, one with a null."""
    rows = [(1, [0.0, 0.0, 6.0, 0.0, 6.0, 4.0, 0.0, 4.0]), (1, [2.0, 1.0, 4.0, 1.0, 4.0, 3.0, 2.0, 3.0]), (2, [0.0, 0.0, 1.0, 1.0]), (3, [0.0, 0.0, None, 0.0, 2.0, 2.0])]
    runs = rasters.rasterize_polygons(spark.createDataFrame(rows, "k long, points array<double>"), ["k"])
    assert {tuple(r) for r in runs.filter("k < 3").collect()} == {(1, 0, 0, 6), (1, 1, 0, 2), (1, 1, 4, 6), (1, 2, 0, 2), (1, 2, 4, 6), (1, 3, 0, 6)}
    assert [e.split("#")[0] for e in exchanges(runs.filter("k < 3"))] == ["k"]


def test_runs_of_masks_are_shuffled_by_keys_alone(spark):
    rows = [(1, 0, 5, 0, 0.5, [0, 3, 10, 13], 10), (1, 0, 6, 0, 0.4, [35, 38], 10)]
    masks = spark.createDataFrame(rows, "image_id long, category_id long, id long, iscrowd int, score double, runs array<bigint>, width long")
    boxed = sweeps.with_boxes(masks)
    met = sweeps.mask_pairs(boxed.withColumnRenamed("id", "gt_id"), boxed.withColumnRenamed("id", "det_id"))
    assert [(r["det_id"], r["gt_id"], r["v"]) for r in met.orderBy("det_id").collect()] == [(5, 5, 1.0), (6, 6, 1.0)]
    assert not [e for e in exchanges(met) if "_id#" in e.split("category_id#")[1].split(")")[0]]


def test_pixels_of_an_image_are_dealt_once(spark):
    """Orders are shuffled before they become pixels; after that nothing is, and a part has so many orders whatever the table."""
    from labelmill.plans import fixtures, registry

    before, fixtures.ORDERS = fixtures.ORDERS, 400
    try:
        for name in ("rle_encode", "rle_round_trip", "mask_union", "uncertainty_sample"):
            found = exchanges(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
            assert len(found) == 1 and found[0].startswith("FLOOR((cast(o_orderkey"), (name, found)
            assert ", 4)" in found[0], found  # 1,500 orders
    finally:
        fixtures.ORDERS = before


def test_segment_ids_of_one_side(spark):
    from labelmill.operators import annotations as ann

    a = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, None)], "image_id long, seg_id long")
    b = spark.createDataFrame([(1, 2), (1, 3), (2, None)], "image_id long, seg_id long")
    found = ann.id_differences(a, b)
    assert len(exchanges(found)) == 1
    assert sorted(map(str, map(tuple, found.collect()))) == ["(1, 1, 'raster')", "(1, 3, 'document')", "(2, None, 'document')", "(2, None, 'raster')"]


def test_pairs_of_masks_meet_in_whole_images(spark):
    """Against the join: several batches, points of only one side, a repeated point, missing values."""
    from labelmill.functions import activations as act
    from labelmill.operators import matching

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        pred = spark.createDataFrame([(i, p, q, None if (i, p, q) == (1, 2, 1) else float((p * 3 + q + i) % 7 - 3)) for i in range(9) for q in range(3) for p in range(5)] + [(2, 1, 0, 9.0)], "image_id long, p long, q long, logit double")
        gt = spark.createDataFrame([(i, p, g, None if (i, p) == (4, 3) else float((p + g + i) % 2)) for i in range(1, 10) for g in range(2) for p in range(1, 7)], "image_id long, p long, gt_id long, t double")
        got = matching.mask_pair_costs(pred, gt)
        assert [e.split("#")[0] for e in exchanges(got)] == ["image_id"]
        prob = act.sigmoid(F.col("logit"))
        met = pred.withColumn("prob", prob).join(gt, ["image_id", "p"]).groupBy("image_id", "q", "gt_id").agg(
            (1.0 - (2.0 * F.sum(F.col("prob") * F.col("t")) + 1.0) / (F.sum("prob") + F.sum("t") + 1.0)).alias("dice"), F.avg(act.bce_with_logits(F.col("logit"), F.col("t"))).alias("bce"))
        key = lambda df: {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
        a, b = key(got), key(met)
        assert a.keys() == b.keys() and len(a) == 8 * 6
        assert all(abs(x - y) < 1e-12 for k in a for x, y in zip(a[k], b[k]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_row_goes_by_its_category(spark):
    """Tables of one row a category are broadcast whatever Spark takes their size for."""
    import re

    from labelmill.plans import registry

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("precision_recall", "box_ap"):
            plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"SortMergeJoin\S* \[category_id#\d+L?\]", plan), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_boundary_areas_equal_the_bands(spark):
    rows = [(k, [v for y in range(k % 5) for v in (y * 20 + 2, y * 20 + 4 + k)], 20, 1 + k % 2) for k in range(12)]
    masks = spark.createDataFrame(rows, "k int, runs array<bigint>, width bigint, d int").repartition(3)
    want = {r["k"]: (r["a"], r["b"]) for r in sweeps.with_boundary(masks, F.col("d")).select("k", sweeps.area(F.col("runs")).alias("a"), sweeps.area(F.col("band")).alias("b")).collect()}
    found = sweeps.boundary_areas(masks, F.col("d"))
    assert found.columns == ["k", "d", "area", "band"]
    assert {r["k"]: (r["area"], r["band"]) for r in found.collect()} == want


def test_streams_of_more_rows_have_more_files(spark, monkeypatch):
    """The rows are landed once; a set of files is a micro-batch and has all rows of its number."""
    from pathlib import Path

    from labelmill.plans import box_queries

    monkeypatch.setattr(box_queries, "FRAMES", 10)
    made = []
    monkeypatch.setattr(box_queries, "scratch_dir", lambda s, real=box_queries.scratch_dir: made.append(real(s)) or made[-1])
    assert box_queries._in_files(spark.range(180), F.col("id"), 3).isStreaming
    for k in range(3):
        folder = Path(f"{made[0]}/{k}")
        assert len(list(folder.glob("part-*.parquet"))) == 6
        assert {r["id"] % 3 for r in spark.read.parquet(str(folder)).collect()} == {k}


def test_short_documents_are_neither_shuffled_nor_landed(spark, tmp_path, monkeypatch):
    """As the byte ranges give them: a byte order mark, a null, a value that does not fit, a document without images."""
    import json

    from labelmill.sources import jsonsplit, readers, scratch

    items = [{"id": 1, "image_id": "7", "bbox": [0.5, 1, 2, 3]}, {"id": "odd", "image_id": "7", "iscrowd": 1}, None, {"id": 3, "image_id": "8"}, {"id": 4, "image_id": "9", "iscrowd": 0}]
    images = [{"id": str(i), "file_name": f"{i}.jpg", "height": i, "width": 5} for i in (7, 8)]
    (tmp_path / "a.json").write_text("﻿" + json.dumps({"info": {"a": [1]}, "images": images, "annotations": items}), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"annotations": items[:1] * 50, "images": images[:1], "none": None}, indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"annotations": items[:1]}))
    found = {}
    for size in (4 << 20, 400, -1):  # all whole, one of them whole, none
        monkeypatch.setattr(jsonsplit, "WHOLE", size, raising=False)
        made = []
        monkeypatch.setattr(jsonsplit, "land", lambda df: made.append(1) or scratch.land(df))
        df = readers.read_instance_json(spark, str(tmp_path))
        found[size] = sorted(str(tuple(r)) for r in df.collect())
        assert bool(made) == (size < 4 << 20), size
    assert len(found[-1]) == 53 and found[-1] == found[400] == found[4 << 20]


def written(spark, monkeypatch, name):
    """The documents that a query writes, and their folder."""
    from labelmill.plans import io_queries, registry

    docs, folders = [], []
    monkeypatch.setattr(io_queries, "_written", lambda df, body, real=io_queries._written: docs.append(df) or folders.append(real(df, body)) or folders[-1])
    registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    return docs[0], folders[0].removeprefix("file:")


def test_lines_are_dealt_by_document_once(spark, monkeypatch):
    """Into parts of so many lines, whatever the table; each document is a file, none a folder."""
    from pathlib import Path

    from labelmill.plans import io_queries

    monkeypatch.setattr(io_queries, "LINES", 1000, raising=False)
    docs, folder = written(spark, monkeypatch, "instance_round_trip")
    found = exchanges(docs)
    assert len(found) == 1 and found[0].startswith("FLOOR((cast(image_id") and ", 6), REPARTITION" in found[0], found  # 6,000 lines
    assert not [p for p in Path(folder).iterdir() if p.is_dir()]
    assert len([p for p in Path(folder).glob("part-*.txt") if p.stat().st_size]) == docs.count() == 2  # the first part has a file in any case


def test_orders_are_dealt_by_document_once(spark, monkeypatch):
    """Pixels, run lengths and documents need no other shuffle, and the encoder sorts pixels once."""
    from labelmill.plans import fixtures

    monkeypatch.setattr(fixtures, "ORDERS", 400)
    for name in ("prediction_round_trip", "panoptic_round_trip"):
        docs, _ = written(spark, monkeypatch, name)
        found = exchanges(docs)
        assert len(found) == 1 and found[0].startswith("FLOOR((cast(FLOOR((cast(o_orderkey") and ", 4), REPARTITION" in found[0], (name, found)
    px = spark.createDataFrame([(1, p % 4, p // 4) for p in (1, 2, 2, 3, 6, 15)] + [(2, 0, 0)], "k long, y long, x long")
    rle = rasters.rle_encode(px, ["k"], 4, 4)
    assert rle._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert {r["k"]: r["rle"]["counts"] for r in rle.collect()} == {1: [1, 3, 2, 1, 8, 1], 2: [0, 1, 15]}


def test_panoptic_segments_are_named_where_they_are_read(spark, tmp_path):
    """Unknown and missing categories, segments without id, annotations without segments, and two of one image."""
    import json

    from labelmill.sources import readers

    seg = lambda i, c: {"id": i, "category_id": c, "area": 1, "bbox": [0, 0, 1, 1], "iscrowd": 0}
    items = [("1", [seg(5, 20), seg(4, 10), seg(3, 99), seg(2, None), seg(None, 10)]), ("2", []), ("3", None), ("1", [seg(9, 30)])]
    (tmp_path / "p.json").write_text(json.dumps({"annotations": [{"image_id": i, "file_name": f"{i}.png", "segments_info": s} for i, s in items]}))
    cats = spark.createDataFrame([(0, 20, 0), (1, 10, 1), (2, 30, 1)], "pos long, id int, isthing int")
    df = readers.read_panoptic_json(spark, str(tmp_path), cats, "a", "b", cast_image_id=True)
    assert not [e for e in exchanges(df) if "image_id#" in e]
    found = [(r["image_id"], r["file_name"], [(s["id"], s["category_id"], s["isthing"]) for s in r["segments_info"]]) for r in df.collect()]
    assert sorted(found) == [(1, "a/1.jpg", [(5, 0, False), (4, 0, True), (3, None, None), (2, None, None)]), (1, "a/1.jpg", [(9, 1, True)]), (2, "a/2.jpg", []), (3, "a/3.jpg", [])]


def test_annotations_meet_images_in_as_many_parts_as_are_read(spark, tmp_path):
    import json

    from labelmill.sources import readers

    for k in range(12):
        (tmp_path / f"{k}.json").write_text(json.dumps({"images": [{"id": "1", "file_name": f"{k}.jpg"}], "annotations": [{"id": k, "image_id": "1"}]}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        df = readers.read_instance_json(spark, str(tmp_path))
        assert len(exchanges(df)) == 2 and all(", 12), REPARTITION" in e for e in exchanges(df)), exchanges(df)
        assert sorted((r["id"], r["file_name"]) for r in df.collect()) == [(k, f"{k}.jpg") for k in range(12)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
