"""Registered queries that write documents in their file formats and read them back, and checks, catalogue and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions import geometry as G
from ..operators import annotations as ann
from ..operators import matching, metrics, rasters
from ..sources import readers
from ..sources.scratch import scratch_dir
from ..streaming import frames as streams
from .catalog import Catalog
from .decode_queries import _HL, _I, _T, _truth
from .fixtures import DOCUMENT, LINES, SIDE, dealt, frame, oracle
from .raster_queries import _DOC, _ID, _segments

Q: dict = {}
SQL: dict[str, str] = {}


def _written(docs: DataFrame, body: Column) -> str:
    """One JSON document for each row, each in a file of its own; returns their folder."""
    path = scratch_dir(docs.sparkSession)
    docs.select(F.to_json(body).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def panoptic_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Panoptic documents of 100 images each, written and read with contiguous category ids."""
    seg = _segments(spark, d, F.floor(F.col("image_id") / 100).alias("doc"), by=DOCUMENT)[1].withColumns({"area": F.lit(1).cast("bigint"), **{c: F.lit(0) for c in ("x", "y", "w", "h")}})
    rows = readers.panoptic_documents(seg, "doc")
    item = F.struct(F.col("image_id").cast("string").alias("image_id"), "file_name", "segments_info")
    path = _written(rows.groupBy("doc").agg(F.collect_list(item).alias("annotations")), F.struct("annotations"))
    back = readers.read_panoptic_json(spark, path, frame(spark, d, "categories"), "images", "labels", cast_image_id=True)
    return back.select("image_id", "file_name", "pan_seg_file_name", F.explode("segments_info").alias("s")).select("image_id", "file_name", "pan_seg_file_name", F.col("s.id").alias("seg_id"), F.col("s.category_id").alias("contiguous_id"), F.col("s.isthing").alias("isthing"))


Q["panoptic_round_trip"] = panoptic_round_trip
SQL["panoptic_round_trip"] = oracle(
    ("px", "categories"), f"select d.image_id, concat('images/',cast(d.image_id as varchar),'.jpg') as file_name, concat('labels/',cast(d.image_id as varchar),'.png') as pan_seg_file_name, d.seg_id, i.contiguous_id, i.isthing=1 as isthing from dc d left join {_ID} i on i.id=d.category_id", *_DOC)


def instance_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Instance documents of 1,000 images each: images and annotations in one file, joined again when read."""
    gt = dealt(frame(spark, d, "gt_box"), "floor(image_id/1000)", LINES)
    item = F.struct(F.col("ann_id").alias("id"), F.col("image_id").cast("string").alias("image_id"), "iscrowd", "category_id", F.array("x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("bbox"))
    image = lambda i: F.struct(i.alias("id"), F.concat(i, F.lit(".jpg")).alias("file_name"), F.lit(400).alias("height"), F.lit(500).alias("width"))
    docs = gt.groupBy(F.floor(F.col("image_id") / 1000).alias("doc")).agg(F.collect_list(item).alias("annotations"), F.transform(F.collect_set(F.col("image_id").cast("string")), image).alias("images"))
    back = readers.read_instance_json(spark, _written(docs, F.struct("images", "annotations")))
    box = G.xywh_to_xyxy([F.col("bbox")[i] for i in range(4)])
    return back.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("id").alias("ann_id"), "file_name", "iscrowd", *[c.alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))])


Q["instance_round_trip"] = instance_round_trip
SQL["instance_round_trip"] = oracle(("gt_box",), "select image_id, ann_id, concat(cast(image_id as varchar),'.jpg') as file_name, iscrowd, x0, y0, x1, y1 from gt_box")


def prediction_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Lists of predicted segments with run lengths, paired with truth by file stem."""
    px = frame(spark, d, "px", DOCUMENT).filter("pred <> 10").select(F.floor(F.col("image_id") / 100).alias("doc"), "image_id", F.col("pred").alias("label"), "y", "x")
    rle = rasters.rle_encode(px, ["image_id", "label", "doc"], SIDE, SIDE)
    item = F.struct(F.concat(F.lit("d/"), F.col("image_id").cast("string"), F.lit(".x.jpg")).alias("file_name"), F.col("label").alias("category_id"), F.col("rle").alias("segmentation"))
    docs = rle.groupBy("doc").agg(F.collect_list(item).alias("v"))
    back = readers.read_predictions(spark, _written(docs, F.col("v")))
    return back.select(F.col("stem").cast("bigint").alias("image_id"), "category_id", rasters.rle_area(F.col("rle")).alias("area"))


Q["prediction_round_trip"] = prediction_round_trip
SQL["prediction_round_trip"] = oracle(("px",), "select image_id, pred as category_id, count(*) as area from px where pred<>10 group by 1, 2")


def detection_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Detections as JSON lines, read back without boxes."""
    path = scratch_dir(spark)
    readers.write_detections(frame(spark, d, "det_box").select("image_id", "category_id", F.array("x0", "y0", F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("bbox"), "score"), path)
    return readers.read_detections(spark, path, drop_boxes=True, lines=True).select("image_id", "category_id", "score")


Q["detection_round_trip"] = detection_round_trip
SQL["detection_round_trip"] = oracle(("det_box",), "select image_id, category_id, score from det_box")


def raster_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Label rasters as Parquet by split, read back; the split is a folder, so one of them alone is a pruned scan."""
    path = scratch_dir(spark)
    readers.write_rasters(frame(spark, d, "px").select("image_id", "y", "x", "gt", F.when(F.col("image_id") % 5 == 0, "val").otherwise("train").alias("split")), path)
    return spark.read.parquet(path).groupBy("split", "gt").agg(F.count("*").alias("n"))


Q["raster_round_trip"] = raster_round_trip
SQL["raster_round_trip"] = oracle(("px",), "select case when image_id%5=0 then 'val' else 'train' end as split, gt, count(*) as n from px group by 1, 2")


def annotation_sink(spark: SparkSession, d: str) -> DataFrame:
    """The three outputs of an annotation set, each read back and counted."""
    path, gt = scratch_dir(spark), frame(spark, d, "gt_box")
    readers.write_instances(gt.select("image_id").distinct(), frame(spark, d, "categories"), gt.select("ann_id", "image_id", "category_id"), path, "json")
    counts = [spark.read.schema("image_id long").json(f"{path}/{n}").agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n") for n in ("images", "categories", "annotations")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


Q["annotation_sink"] = annotation_sink
SQL["annotation_sink"] = oracle(("gt_box", "categories"), "select 'images' as part, count(distinct image_id) as n from gt_box union all select 'categories', count(*) from categories union all select 'annotations', count(*) from gt_box")


def annotation_tables(spark: SparkSession, d: str) -> DataFrame:
    """An annotation set written as Parquet tables and joined again from them: all values of every annotation."""
    path, gt = scratch_dir(spark), frame(spark, d, "gt_box")
    readers.write_instances(gt.select("image_id", F.lit(400).alias("height")).distinct(), frame(spark, d, "categories"), gt, path)
    images, categories, annotations = (spark.read.parquet(f"{path}/{n}") for n in ("images", "categories", "annotations"))
    named = categories.select(F.col("pos").alias("category_id"), "name")
    return annotations.join(images, "image_id").join(named, "category_id", "left").select("image_id", "ann_id", "name", "height", "x0", "y0", "x1", "y1", "iscrowd")


Q["annotation_tables"] = annotation_tables
SQL["annotation_tables"] = oracle(("gt_box", "categories"), "select image_id, ann_id, name, 400 as height, x0, y0, x1, y1, iscrowd from gt_box g left join categories c on c.pos=g.category_id")


def id_map_file(spark: SparkSession, d: str) -> DataFrame:
    """An id map as a text file with a header, every instance id twice, read back: the later line counts."""
    path = scratch_dir(spark)
    rows = frame(spark, d, "id_map")
    lines = rows.select(F.concat_ws("\t", F.col("ins_id"), F.lit(99), F.lit("old")).alias("v"), "ins_id", F.lit(0).alias("k")).unionByName(rows.select(F.concat_ws(" ", F.col("ins_id"), F.col("sem_id") + 1, F.lit("new")).alias("v"), "ins_id", F.lit(1).alias("k")))
    whole = lines.agg(F.concat_ws("\n", F.lit("ins sem name"), F.transform(F.sort_array(F.collect_list(F.struct("k", "ins_id", "v"))), lambda x: x["v"])).alias("value"))  # a mapping of a few ids
    whole.write.option("lineSep", "\n").text(path)
    return readers.read_id_map(spark, f"{path}/part-*")


Q["id_map_file"] = id_map_file
SQL["id_map_file"] = oracle(("id_map",), "select ins_id, sem_id from id_map")


def raster_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of every customer's name as a grey image of two rows, and of colours packed from threes."""
    names = frame(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("stem"), F.col("c_name").cast("binary").alias("data"))
    grey = names.select("stem", F.lit(2).alias("height"), F.floor(F.octet_length("data") / 2).cast("int").alias("width"), F.lit(1).alias("nChannels"), "data")
    rgb = names.select("stem", F.lit(1).alias("height"), F.floor(F.octet_length("data") / 3).cast("int").alias("width"), F.lit(3).alias("nChannels"), "data")
    both = readers.raster_pixels(grey).withColumn("kind", F.lit("grey")).unionByName(readers.raster_pixels(rgb, "rgb_id").withColumn("kind", F.lit("rgb")))
    return both.groupBy("kind", F.col("stem").cast("bigint").alias("c_custkey"), "y").agg(F.count("*").alias("n"), F.sum(F.col("label") * (F.col("x") + 1)).alias("weighted"))


Q["raster_bytes"] = raster_bytes
SQL["raster_bytes"] = """with c as (select c_custkey, c_name, length(c_name) as l from customer),
 g as (select c_custkey, cast(floor(p/floor(l/2)) as bigint) as y, cast(p%floor(l/2) as bigint) as x, ascii(c_name[p+1]) as label from (select *, unnest(range(cast(2*floor(l/2) as bigint))) as p from c) z),
 r as (select c_custkey, 0 as y, p as x, ascii(c_name[3*p+3])+256*ascii(c_name[3*p+2])+65536*ascii(c_name[3*p+1]) as label from (select *, unnest(range(cast(floor(l/3) as bigint))) as p from c) z)
 select kind, c_custkey, cast(y as bigint) as y, count(*) as n, cast(sum(label*(x+1)) as bigint) as weighted from (select 'grey' as kind, * from g union all select 'rgb', * from r) v group by 1, 2, 3"""


def category_file(spark: SparkSession, d: str) -> DataFrame:
    """A category dimension kept as CSV, read back, its evaluated rows alone."""
    path = scratch_dir(spark) + ".csv"
    frame(spark, d, "categories").withColumn("evaluate", F.col("pos") % 3 != 1).write.option("header", True).csv(path)
    return ann.evaluated(readers.read_categories(spark, path)).select(F.col("id").cast("bigint").alias("id"), "name", F.col("isthing").cast("bigint").alias("isthing"))


Q["category_file"] = category_file
SQL["category_file"] = oracle(("categories",), "select id, name, cast(isthing as bigint) as isthing from categories where pos%3<>1")

# --- checks, catalogue, codes ------------------------------------------------------------------------------------
Q["dataset_checks"] = lambda s, d: ann.dataset_checks({"boxes": frame(s, d, "gt_box"), "none": frame(s, d, "gt_box").filter("ann_id < 0")}, frame(s, d, "categories"), most=10)
SQL["dataset_checks"] = oracle(
    ("gt_box", "categories"), "select 'boxes is not empty' as rule, count(*) as value, count(*)>0 as passed from gt_box union all select 'none is not empty', count(*), count(*)>0 from gt_box where ann_id<0 union all select 'at most 10 categories', count(*), count(*)<=10 from categories")
Q["unknown_predictions"] = lambda s, d: metrics.unknown_predictions(metrics.overlaps(frame(s, d, "px")), frame(s, d, "categories").filter("pos <> 9").select(F.col("pos").alias("category_id")), 255)
SQL["unknown_predictions"] = oracle(("px",), "select image_id, pred, count(*) as pixels from px where pred=9 or pred=255 group by 1, 2")
Q["without_annotations"] = lambda s, d: ann.without_columns(frame(s, d, "frames"), "annotations_json", "latency_ms", "ts")
SQL["without_annotations"] = oracle(("frames",), "select stream_id, frame_idx, event_id from frames")
Q["flat_indices"] = lambda s, d: frame(s, d, "query_cls").select("image_id", (F.col("q") * 6 + F.col("c")).alias("i")).select("image_id", *[c.cast("bigint").alias(n) for c, n in zip(codes.split_flat_index(F.col("i"), 6), ("q", "c"))])
SQL["flat_indices"] = oracle(("query_cls",), "select image_id, q, c from query_cls")


def catalogued(spark: SparkSession, d: str) -> DataFrame:
    """A dataset and a mapper by name."""
    known = Catalog()
    known.register("boxes", lambda s: frame(s, d, "gt_box"), classes=5)
    known.mapper("visible", lambda df, least: ann.keep_objects(df, least))
    return known.mapped(known.load(spark, "boxes"), "visible", least=0.8).groupBy("category_id").agg(F.count("*").alias("n"))


Q["catalogued_boxes"] = catalogued
SQL["catalogued_boxes"] = oracle(("gt_box",), "select category_id, count(*) as n from gt_box where iscrowd=0 and visibility_fraction>=0.8 group by 1")


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """Truth boxes as polygons, mirrored and halved, filled: covered pixels of each."""
    points = F.array("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1")
    moved = G.scale_polygon(G.hflip_polygon(points, F.lit(500.0)), F.lit(0.5), F.lit(0.5))
    runs = rasters.rasterize_polygons(frame(spark, d, "gt_box").select("image_id", "ann_id", F.col("x1").alias("right"), moved.alias("points")), ["image_id", "ann_id", "right"])
    return runs.groupBy("image_id", "ann_id", "right").agg(F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.min("x0").alias("x0"), F.min("y").alias("y0"))


Q["polygon_pixels"] = polygons
SQL["polygon_pixels"] = oracle(
    ("gt_box",), "select image_id, ann_id, x1 as \"right\", cast((ceil(b-0.5)-ceil(a-0.5))*(ceil(y1/2-0.5)-ceil(y0/2-0.5)) as bigint) as pixels, cast(ceil(a-0.5) as bigint) as x0, cast(ceil(y0/2-0.5) as bigint) as y0 from (select *, (500-x1)/2 as a, (500-x0)/2 as b from gt_box) z")
Q["boundary_by_size"] = lambda s, d: rasters.boundary_band(frame(s, d, "px").select("image_id", "y", "x", F.col("gt").alias("label")), ["image_id", "label"], rasters.boundary_distance(F.lit(SIDE), F.lit(SIDE) + F.col("image_id") % 40, 0.05)).groupBy("image_id", "label").agg(F.count("*").alias("band"))
SQL["boundary_by_size"] = oracle(
    ("px",), "select image_id, label, count(*) as band from b where n<(2*d+1)*(2*d+1) group by 1, 2",
    "v as (select *, greatest(1,cast(round_even(0.05*sqrt(64+pow(8+image_id%40,2)),0) as int)) as d from px)",
    "b as (select p.image_id, p.gt as label, p.y, p.x, p.d, count(*) as n from v p join v o on o.image_id=p.image_id and o.gt=p.gt and o.y between p.y-p.d and p.y+p.d and o.x between p.x-p.d and p.x+p.d group by all)")


def branches(spark: SparkSession, d: str) -> DataFrame:
    """Box losses of all queries and of each query as a layer of the denoising branch, in one table of metrics."""
    box, truth = frame(spark, d, "query_box"), _truth(spark, d)
    pairs = matching.gather(box.select("image_id", "q", F.col("q").alias("gt_id")), box, truth)
    parts = {("", None): matching.box_losses(pairs), **{("dn", i): matching.box_losses(pairs.filter(F.col("q") == i)) for i in range(4)}}
    return metrics.merged_branches(parts).select("metric", "branch", "layer", F.round("value", 6).alias("value"))


Q["metric_branches"] = branches
_LOSS = f"j as (select b.q, abs(b.cx-t.cx)+abs(b.cy-t.cy)+abs(b.w-t.w)+abs(b.h-t.h) as l1, {_I} as i, b.w*b.h+t.w*t.h-{_I} as u, {_HL} as hl from query_box b join {_T} t on t.image_id=b.image_id and t.gt_id=b.q)"
SQL["metric_branches"] = oracle(
    ("query_box",), "select concat('loss_bbox',s) as metric, branch, layer, round(l,6) as value from a union all select concat('loss_giou',s), branch, layer, round(g,6) from a", _LOSS,
    "a as (select '' as s, '' as branch, cast(null as int) as layer, avg(l1) as l, avg(1.0-(i/u-(hl-u)/hl)) as g from j union all select concat('_dn_',cast(q as varchar)), 'dn', cast(q as int), avg(l1), avg(1.0-(i/u-(hl-u)/hl)) from j group by q)")

# --- streams -----------------------------------------------------------------------------------------------------


def scored_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream over the events files, scored by the function that scores a table."""
    out, state = scratch_dir(spark), scratch_dir(spark)
    events = spark.readStream.schema(frame(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    scored = streams.score_stream(events, lambda f: f.select("event_id", (F.col("value") * 2).alias("score")).filter("score > 50"))
    scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, score double").parquet(out).select("event_id", F.round("score", 6).alias("score"))


Q["scored_stream"] = scored_stream
SQL["scored_stream"] = "select event_id, round(value*2,6) as score from events where value*2>50"
