"""Readers and writers on tiny files."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from labelmill.plans.catalog import Catalog
from labelmill.sources import jsonsplit, readers


def png(path, rows, channels):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(v for px in row for v in (px if channels == 3 else (px,))) for row in rows)
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2 if channels == 3 else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_rasters_from_png(spark, tmp_path):
    png(tmp_path / "a.png", [[1, 2, 3], [4, 5, 6]], 1)
    px = readers.raster_pixels(readers.read_images(spark, str(tmp_path)))
    assert {(r["y"], r["x"]): r["label"] for r in px.collect()} == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): 4, (1, 1): 5, (1, 2): 6}
    rgb = tmp_path / "rgb"
    rgb.mkdir()
    png(rgb / "b.png", [[(1, 2, 3), (255, 0, 1)]], 3)
    got = {(r["y"], r["x"]): r["label"] for r in readers.raster_pixels(readers.read_images(spark, str(rgb)), "rgb_id").collect()}
    assert got == {(0, 0): 1 + 2 * 256 + 3 * 65536, (0, 1): 255 + 65536}
    assert [(r["stem"], r["height"], r["width"]) for r in readers.inventory(readers.read_images(spark, str(rgb))).collect()] == [("b", 1, 2)]


def test_panoptic_and_instance_documents(spark, tmp_path):
    doc = {
        "images": [{"id": "7", "file_name": "7.jpg", "height": 4, "width": 5}],
        "categories": [{"id": 10, "name": "a", "isthing": 1}, {"id": 20, "name": "b", "isthing": 0}],
        "annotations": [{"image_id": "7", "file_name": "7.png", "segments_info": [{"id": 3, "category_id": 20, "area": 4, "bbox": [0, 0, 2, 2], "iscrowd": 0}, {"id": 1, "category_id": 10, "area": 2, "bbox": [0, 0, 1, 2], "iscrowd": 1}]}, {"image_id": "8", "file_name": "8.png", "segments_info": []}],
    }
    path = tmp_path / "pan.json"
    path.write_text(json.dumps(doc))
    cats = readers.read_categories_json(spark, str(path))
    rows = readers.read_panoptic_json(spark, str(path), cats, "img", "lab", cast_image_id=True).orderBy("image_id").collect()
    assert [r["image_id"] for r in rows] == [7, 8]
    assert rows[0]["file_name"] == "img/7.jpg" and rows[0]["pan_seg_file_name"] == "lab/7.png"
    assert [(s["id"], s["category_id"], s["isthing"]) for s in rows[0]["segments_info"]] == [(3, 1, False), (1, 0, True)]
    assert rows[1]["segments_info"] == []
    inst = tmp_path / "inst.json"
    inst.write_text(json.dumps({"images": doc["images"], "categories": [], "annotations": [{"id": 1, "image_id": "7", "category_id": 2, "bbox": [0, 0, 1, 1], "area": 1}]}))
    row = readers.read_instance_json(spark, str(inst)).first()
    assert row["file_name"] == "7.jpg" and row["iscrowd"] is None


def test_id_map_predictions_and_detections(spark, tmp_path):
    (tmp_path / "map.txt").write_text("ins sem full\n1\t5\tx\n2 6 y\n1 9 x\n")
    assert {r["ins_id"]: r["sem_id"] for r in readers.read_id_map(spark, str(tmp_path / "map.txt")).collect()} == {1: 8, 2: 5}
    (tmp_path / "pred.json").write_text(json.dumps([{"file_name": "d/a.b.jpg", "category_id": 3, "segmentation": {"size": [2, 2], "counts": [1, 3]}}]))
    row = readers.read_predictions(spark, str(tmp_path / "pred.json")).first()
    assert row["stem"] == "a" and row["rle"]["counts"] == [1, 3]
    (tmp_path / "det.json").write_text(json.dumps([{"image_id": 1, "category_id": 3, "bbox": [0, 0, 1, 1], "score": 0.5}]))
    assert "bbox" not in readers.read_detections(spark, str(tmp_path / "det.json"), drop_boxes=True).columns


def test_frames_and_sinks(spark, tmp_path):
    frames = spark.createDataFrame([("s/b.png", 4, 5, '[{"category_id":1}]'), ("s/a.png", 4, 5, None), ("r/z.png", 4, 5, "[]")], "path string, height int, width int, coco_annotations string")
    rows = readers.frames_with_annotations(frames).orderBy("image_id").collect()
    assert [(r["image_id"], r["path"]) for r in rows] == [(0, "r/z.png"), (1, "s/a.png"), (2, "s/b.png")]
    assert readers.exploded_annotations(readers.frames_with_annotations(frames)).count() == 3
    px = spark.createDataFrame([(1, 0, 0, 2, "val")], "image_id long, y long, x long, label long, split string")
    readers.write_rasters(px, str(tmp_path / "px"))
    assert spark.read.parquet(str(tmp_path / "px")).filter("split = 'val'").count() == 1
    seg = spark.createDataFrame([(1, 2, 5, 9, 0, 0, 3, 3), (1, 1, 4, 9, 0, 0, 3, 3)], "image_id long, seg_id long, category_id long, area long, x long, y long, w long, h long")
    assert [s["id"] for s in readers.panoptic_documents(seg).first()["segments_info"]] == [1, 2]
    readers.write_detections(seg, str(tmp_path / "det"))
    readers.write_instances(seg, seg, seg, str(tmp_path / "inst"))
    assert spark.read.parquet(str(tmp_path / "inst/annotations")).count() == 2
    readers.write_instances(seg, seg, seg, str(tmp_path / "lines"), "json")
    assert spark.read.json(str(tmp_path / "lines/images")).count() == 2
    assert spark.read.json(str(tmp_path / "det")).count() == 2


def test_catalog_is_lazy(spark):
    catalog, calls = Catalog(), []
    catalog.register("n", lambda s: calls.append(1) or s.range(3), ignore_label=255)
    assert not calls
    assert catalog.load(spark, "n").count() == 3 and calls == [1]
    catalog.mapper("double", lambda df, by: df.select((F.col("id") * by).alias("id")))
    assert catalog.mapped(catalog.load(spark, "n"), "double", by=2).agg(F.max("id")).first()[0] == 4
    assert catalog.describe(spark).first()["value"] == "255"


def odd_document(rng, n):
    """A document with braces, quotes and escapes in strings, nested objects and arrays, and values beside the arrays."""
    words = ["a", "{", "}", '"', "\\", "[", "]", "}}", "é", "\n", '\\"', ",", ":", "日本", "x" * 50, '"annotations":[{']
    text = lambda: "".join(rng.choice(words) for _ in range(rng.randint(0, 6)))
    item = lambda i: {"id": i, "image_id": text(), "segmentation": {"size": [i, 2], "counts": [1, 2, 3]} if rng.random() < 0.5 else None, "bbox": [1.5, 2.0, 3.0, i + 0.5], "extra": rng.choice([None, {"deep": {"er": [{}, {"q": text()}]}}])}
    image = lambda i: {"id": text(), "file_name": text(), "height": i, "width": 7}
    parts = [("info", {"year": 1, "by": {"name": text(), "more": [{"a": {}}]}}), ("annotations", [item(i) for i in range(n)]), ("none", []), ("images", [image(i) for i in range(n)]), ("sizes", [1, 2, [3]]), ("licences", [[{"id": 5}]]), ("last", text())]
    rng.shuffle(parts)
    return dict(parts)


@pytest.mark.parametrize(("seed", "indent"), [(1, None), (2, 1), (3, None)])
def test_documents_are_read_in_byte_ranges(spark, tmp_path, seed, indent):
    """Several documents cut into many ranges give the records that a parser gives, in order."""
    rng = random.Random(seed)
    docs = {f"d{k}.json": odd_document(rng, n) for k, n in enumerate((0, 1, 400))}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "list").mkdir()
    (tmp_path / "list/l.json").write_text(json.dumps(docs["d2.json"]["annotations"], indent=indent))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = jsonsplit.records(spark, str(tmp_path / "*.json"))
        ranges = jsonsplit._fragments(spark, str(tmp_path / "d2.json")).select("at").distinct().count()
        listed = jsonsplit.records(spark, str(tmp_path / "list"), 1)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ranges > 10
    rows = found.filter("key in ('annotations', 'images')").orderBy("file", "at").collect()
    for name, doc in docs.items():
        for key in ("annotations", "images"):
            assert [json.loads(r["text"]) for r in rows if r["key"] == key and r["file"].endswith(name)] == doc[key]
    assert [json.loads(r["text"]) for r in listed.orderBy("at").collect()] == docs["d2.json"]["annotations"]
    got = jsonsplit.parsed(found, readers.INSTANCE, "annotations").filter("id >= 0").collect()
    assert len(got) == 401 and all(r["bbox"][3] == r["id"] + 0.5 for r in got)
