"""Registered queries over rasters: segments, runs, run lengths, panoptic quality and semantic metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations as ann
from ..operators import metrics, rasters
from ..operators import runs as sweeps
from .fixtures import IMAGE, SIDE, frame, oracle

Q: dict = {}
SQL: dict[str, str] = {}
VOID, CLASSES = 255, 11


def _px(spark: SparkSession, d: str, label: str = "gt") -> DataFrame:
    return frame(spark, d, "px").withColumnRenamed(label, "label").select("image_id", "y", "x", "label")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pq_stats(metrics.overlaps(frame(spark, d, "px")), VOID)


_OVERLAP = "o as (select image_id, gt, pred, count(*) as n from px group by all)"
_PQ = [
    _OVERLAP, "pa as (select image_id, pred, sum(n) as a, sum(case when gt=255 then n else 0 end) as v from o group by all)",
    "ga as (select image_id, gt, sum(n) as a from o where gt<>255 group by all)",
    "m as (select o.image_id, o.gt as c, o.n/(pa.a+ga.a-o.n-pa.v) as iou from o join pa using (image_id, pred) join ga using (image_id, gt) where o.gt=o.pred and o.n/(pa.a+ga.a-o.n-pa.v)>0.5)",
    """s as (select c as category_id, sum(iou) as iou, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (
 select c, iou, 1 as tp, 0 as fp, 0 as fn from m
 union all select gt, 0.0, 0, 0, 1 from ga where not exists (select 1 from m where m.image_id=ga.image_id and m.c=ga.gt)
 union all select pred, 0.0, 0, 1, 0 from pa where pred<>255 and v*2<=a and not exists (select 1 from m where m.image_id=pa.image_id and m.c=pa.pred)) z group by c)""",
    "k as (select category_id, tp, fp, fn, iou/(tp+fp/2+fn/2) as pq, case when tp>0 then iou/tp else 0 end as sq, tp/(tp+fp/2+fn/2) as rq from s where tp+fp+fn>0)",
]


def pq_by_class(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pq_classes(_stats(spark, d)).select("category_id", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("pq", "sq", "rq")])


Q["pq_by_class"] = pq_by_class
SQL["pq_by_class"] = oracle(("px",), "select category_id, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, round(pq,6) as pq, round(sq,6) as sq, round(rq,6) as rq from k", *_PQ)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    cats = frame(spark, d, "categories").select(F.col("pos").alias("category_id"), "isthing")
    return metrics.pq_summary(_stats(spark, d), cats)


Q["pq_summary"] = lambda s, d: _summary(s, d).select("scope", *[F.round(c, 6).alias(c) for c in ("pq", "sq", "rq")], "n")
Q["pq_report"] = lambda s, d: metrics.report(_summary(s, d))
_SCOPES = "w as (select 'All' as scope, k.* from k union all select 'Stuff', k.* from k where category_id>=5)"
SQL["pq_summary"] = oracle(("px",), "select scope, round(avg(pq),6) as pq, round(avg(sq),6) as sq, round(avg(rq),6) as rq, count(*) as n from w group by scope", *_PQ, _SCOPES)
SQL["pq_report"] = oracle(("px",), "select scope, round(100*avg(pq),1) as pq, round(100*avg(sq),1) as sq, round(100*avg(rq),1) as rq, count(*) as n from w group by scope", *_PQ, _SCOPES)

_CONF = "cf as (select pred, case when gt=255 then 11 else gt end as gt, count(*) as n from px group by 1, 2)"


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(frame(spark, d, "px"), VOID, CLASSES)


Q["confusion_matrix"] = _confusion
SQL["confusion_matrix"] = oracle(("px",), "select * from cf", _CONF)


def confusion_from_runs(spark: SparkSession, d: str) -> DataFrame:
    px = frame(spark, d, "px")
    gt, pred = rasters.pixels_to_runs(px.select("image_id", "y", "x", "gt"), "gt"), rasters.pixels_to_runs(px.select("image_id", "y", "x", "pred"), "pred")
    return metrics.confusion(rasters.run_overlap(gt, pred, "gt", "pred"), VOID, CLASSES, weight="n")


Q["confusion_from_runs"] = confusion_from_runs
SQL["confusion_from_runs"] = SQL["confusion_matrix"]

_IOU = [
    _CONF, "inn as (select * from cf where gt<>11 and pred<>11)",
    "c as (select label, sum(tp) as tp, sum(g) as g, sum(p) as p from (select gt as label, case when gt=pred then n else 0 end as tp, n as g, 0 as p from inn union all select pred, 0, 0, n from inn) z group by label)",
]
Q["miou_reference"] = lambda s, d: metrics.miou(_confusion(s, d), CLASSES).select(F.round("miou", 6).alias("miou"), F.round("macc", 6).alias("macc"))
SQL["miou_reference"] = oracle(("px",), "select round(sum(case when g>0 then tp/(g+p-tp) end)/sum(case when g+p>0 then 1 else 0 end),6) as miou, round(avg(case when g>0 then tp/g end),6) as macc from c", *_IOU)
Q["miou_standard"] = lambda s, d: metrics.miou(_confusion(s, d), CLASSES, "standard").select(F.round("miou", 6).alias("miou"), F.round("macc", 6).alias("macc"))
SQL["miou_standard"] = oracle(("px",), "select round(avg(case when g>0 then tp/(g+p-tp) end),6) as miou, round(avg(case when g>0 then tp/g end),6) as macc from c", *_IOU)
Q["semantic_suite"] = lambda s, d: metrics.semantic_suite(_confusion(s, d), CLASSES).select(*[F.round(c, 6).alias(c) for c in ("miou", "fwiou", "macc", "pacc")])
SQL["semantic_suite"] = oracle(("px",), "select round(avg(case when g>0 then tp/(g+p-tp) end),6) as miou, round(sum(case when g>0 then tp/(g+p-tp)*g/(select sum(g) from c) end),6) as fwiou, round(avg(case when g>0 then tp/g end),6) as macc, round(sum(tp)/(select sum(g) from c),6) as pacc from c", *_IOU)

Q["segment_areas"] = lambda s, d: rasters.segment_areas(rasters.without_label(_px(s, d), "label", VOID))
SQL["segment_areas"] = oracle(("px",), "select image_id, gt as label, count(*) as area from px where gt<>255 group by all")
Q["distinct_labels"] = lambda s, d: rasters.distinct_labels(_px(s, d))
SQL["distinct_labels"] = oracle(("px",), "select distinct image_id, gt as label from px")
for _name, _more, _cols in (
    ("inclusive", 0, "min(x) as x0, min(y) as y0, max(x)+0 as x1, max(y)+0 as y1"), ("exclusive", 1, "min(x) as x0, min(y) as y0, max(x)+1 as x1, max(y)+1 as y1"),
    ("xywh", 1, "min(x) as x, min(y) as y, max(x)-min(x)+1 as w, max(y)-min(y)+1 as h"),
):
    Q[f"mask_boxes_{_name}"] = lambda s, d, c=_name: rasters.mask_boxes(_px(s, d), ["image_id", "label"], c)
    SQL[f"mask_boxes_{_name}"] = oracle(("px",), f"select image_id, gt as label, {_cols} from px group by all")
Q["pixel_runs"] = lambda s, d: rasters.pixels_to_runs(_px(s, d))
_RUNS = "r as (select image_id, y, label, min(x) as x0, max(x)+1 as x1 from (select image_id, y, x, gt as label, x-row_number() over (partition by image_id, y, gt order by x) as i from px) z group by image_id, y, label, i)"
SQL["pixel_runs"] = oracle(("px",), "select * from r", _RUNS)
Q["run_areas"] = lambda s, d: rasters.run_areas(rasters.pixels_to_runs(_px(s, d)))
SQL["run_areas"] = oracle(("px",), "select image_id, label, cast(sum(x1-x0) as bigint) as area from r group by all", _RUNS)
Q["runs_round_trip"] = lambda s, d: rasters.runs_to_pixels(rasters.pixels_to_runs(_px(s, d))).select("image_id", "y", "x", "label")
SQL["runs_round_trip"] = oracle(("px",), "select image_id, y, x, gt as label from px")


def _rle(spark: SparkSession, d: str) -> DataFrame:
    return rasters.rle_encode(_px(spark, d).filter("label <> 255"), ["image_id", "label"], SIDE, SIDE)


Q["rle_encode"] = lambda s, d: _rle(s, d).select("image_id", "label", F.concat_ws(",", F.transform("rle.counts", lambda c: c.cast("string"))).alias("counts"), rasters.rle_area(F.col("rle")).alias("area"))
SQL["rle_encode"] = oracle(
    ("px",), "select image_id, label, string_agg(cast(n as varchar), ',' order by a, k) as counts, cast(sum(case when k=1 then n else 0 end) as bigint) as area from f group by image_id, label",
    "p as (select image_id, gt as label, x*8+y as p from px where gt<>255)",
    "i as (select image_id, label, min(p) as a, max(p)+1 as b from (select *, p-row_number() over (partition by image_id, label order by p) as g from p) z group by image_id, label, g)",
    "e as (select *, coalesce(lag(b) over (partition by image_id, label order by a), 0) as before from i)",
    "f as (select image_id, label, a, 0 as k, a-before as n from e union all select image_id, label, a, 1, b-a from e union all select image_id, label, 99999, 2, 64-max(b) from e group by image_id, label having max(b)<64)",
)
Q["rle_round_trip"] = lambda s, d: rasters.rle_decode(_rle(s, d)).select("image_id", "y", "x", "label")
SQL["rle_round_trip"] = oracle(("px",), "select image_id, y, x, gt as label from px where gt<>255")
Q["mask_boxes_default"] = lambda s, d: rasters.mask_boxes_or_default(frame(s, d, "px").select("image_id", F.explode(F.array("gt", "pred")).alias("label")), _px(s, d), ["image_id", "label"])
SQL["mask_boxes_default"] = oracle(("px",), "select m.image_id, m.label, cast(coalesce(min(x),1e8) as double) as x0, cast(coalesce(min(y),1e8) as double) as y0, cast(coalesce(max(x),0) as double) as x1, cast(coalesce(max(y),0) as double) as y1 from (select image_id, gt as label from px union select image_id, pred from px) m left join px p on p.image_id=m.image_id and p.gt=m.label group by 1, 2")
Q["default_fill"] = lambda s, d: rasters.covered(_px(s, d).select("image_id", "y", "x"), _px(s, d).filter("label < 5"), "label", 0)
SQL["default_fill"] = oracle(("px",), "select image_id, y, x, case when gt<5 then gt else 0 end as label from px")


def mask_union(spark: SparkSession, d: str) -> DataFrame:
    """Truth and prediction of a label as one mask: their runs are united, not their pixels."""
    side = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("label")) for c in ("gt", "pred")]))
    runs = rasters.pixels_to_runs(frame(spark, d, "px").select("image_id", "y", "x", side.alias("label")))
    return rasters.run_areas(sweeps.union_runs(runs.withColumn("label", F.col("label.label")), ["image_id", "label"]))


Q["mask_union"] = mask_union
SQL["mask_union"] = oracle(("px",), "select image_id, label, count(*) as area from (select image_id, gt as label, y, x from px union select image_id, pred, y, x from px) z group by all")
Q["boundary_band"] = lambda s, d: rasters.boundary_band(_px(s, d), ["image_id", "label"], 1).groupBy("image_id", "label").agg(F.count("*").alias("band"))
SQL["boundary_band"] = oracle(
    ("px",), "select image_id, label, count(*) as band from b where n<9 group by all",
    "b as (select p.image_id, p.gt as label, p.y, p.x, count(*) as n from px p join px o on o.image_id=p.image_id and o.gt=p.gt and o.y between p.y-1 and p.y+1 and o.x between p.x-1 and p.x+1 group by all)",
)


def boundary_iou(spark: SparkSession, d: str) -> DataFrame:
    px = frame(spark, d, "px")
    bands = [rasters.boundary_band(px.select("image_id", "y", "x", F.col(c).alias("label")), ["image_id", "label"], 1).withColumn(c, F.lit(1)) for c in ("gt", "pred")]
    both = bands[0].join(bands[1], ["image_id", "y", "x", "label"], "full").filter("label <> 255")
    return both.groupBy("label").agg(F.round(F.sum(F.coalesce("gt", F.lit(0)) * F.coalesce("pred", F.lit(0))) / F.count("*"), 6).alias("boundary_iou"))


Q["boundary_iou"] = boundary_iou
_BAND = "{n} as (select image_id, y, x, label from (select p.image_id, p.{c} as label, p.y, p.x, count(*) as n from px p join px o on o.image_id=p.image_id and o.{c}=p.{c} and o.y between p.y-1 and p.y+1 and o.x between p.x-1 and p.x+1 group by all) z where n<9 and label<>255)"
SQL["boundary_iou"] = oracle(
    ("px",), "select label, round(sum(i)/count(*),6) as boundary_iou from (select coalesce(a.label,b.label) as label, case when a.label is not null and b.label is not null then 1 else 0 end as i from a full join b on a.image_id=b.image_id and a.y=b.y and a.x=b.x and a.label=b.label) z group by label",
    _BAND.format(n="a", c="gt"), _BAND.format(n="b", c="pred"),
)

# --- conversions -------------------------------------------------------------------------------------------------
Q["extract_instances"] = lambda s, d: ann.extract_instances(frame(s, d, "parts_px"), frame(s, d, "id_map")).select("id", "image_id", "inst_id", "category_id", "area", "x", "y", "w", "h")
SQL["extract_instances"] = oracle(
    ("parts_px", "id_map"), "select row_number() over (order by image_id, inst_id) as id, image_id, inst_id, sem_id as category_id, area, x, y, w, h from g join id_map using (ins_id)",
    "g as (select image_id, inst_id, min(inst_cat_raw) as ins_id, count(*) as area, min(x) as x, min(y) as y, max(x)-min(x)+1 as w, max(y)-min(y)+1 as h from parts_px where inst_id<>0 group by image_id, inst_id)",
)
Q["single_category_violations"] = lambda s, d: ann.several_categories(frame(s, d, "px").filter("gt <> 255"), ["image_id", "pred"], "gt")
SQL["single_category_violations"] = oracle(("px",), "select image_id, pred, count(distinct gt) as n_categories from px where gt<>255 group by image_id, pred having count(distinct gt)<>1")


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    px = frame(spark, d, "parts_px").select("image_id", "y", "x", F.pmod(F.col("sem_raw") - 1, F.lit(256)).alias("sem"), "inst_id", F.col("inst_cat_raw").alias("inst_cat"))
    cats = frame(spark, d, "categories").select(F.col("pos").alias("id"), "isthing")
    return ann.panoptic_from_parts(px, cats, frame(spark, d, "id_map"))


_PARTS = [
    "pp as (select image_id, y, x, case when sem_raw=0 then 255 else sem_raw-1 end as sem, inst_id, inst_cat_raw as ins_id from parts_px)",
    """sg as (select image_id, sem as category_id, 0 as inst_id, count(*) as area, min(x) as x, min(y) as y, max(x)-min(x)+1 as w, max(y)-min(y)+1 as h from pp where sem<>255 and sem>=5 group by image_id, sem
 union all select image_id, sem_id, inst_id, count(*), min(x), min(y), max(x)-min(x)+1, max(y)-min(y)+1 from pp join id_map using (ins_id) where inst_id<>0 group by image_id, sem_id, inst_id)""",
    "sn as (select *, row_number() over (partition by image_id order by inst_id>0, category_id, inst_id) as seg_id from sg)",
]
Q["panoptic_from_parts_segments"] = lambda s, d: _parts(s, d)[1].select("image_id", "seg_id", "category_id", F.col("inst_id").cast("bigint").alias("inst_id"), "area", "x", "y", "w", "h")
SQL["panoptic_from_parts_segments"] = oracle(("parts_px", "id_map"), "select image_id, seg_id, category_id, cast(inst_id as bigint) as inst_id, area, x, y, w, h from sn", *_PARTS)
Q["panoptic_from_parts_pixels"] = lambda s, d: _parts(s, d)[0].groupBy("image_id", "seg_id").agg(F.count("*").alias("painted"), F.sum(F.col("y") * SIDE + F.col("x")).alias("place"))
SQL["panoptic_from_parts_pixels"] = oracle(
    ("parts_px", "id_map"), """select image_id, seg_id, count(*) as painted, cast(sum(y*8+x) as bigint) as place from (select p.image_id, p.y, p.x, coalesce(i.seg_id, s.seg_id, 0) as seg_id from pp p
 left join sn s on s.image_id=p.image_id and s.inst_id=0 and s.category_id=p.sem left join id_map im on im.ins_id=p.ins_id and p.inst_id<>0 left join sn i on i.image_id=p.image_id and i.inst_id=p.inst_id and i.inst_id>0 and i.category_id=im.sem_id) z group by image_id, seg_id""",
    *_PARTS,
)


def _segments(spark: SparkSession, d: str, *more: Column, by: str = IMAGE) -> tuple[DataFrame, DataFrame]:
    """Pixels with a segment id, and a document that lacks some segments and has one too many; `more` columns of an image go along."""
    image = [F.col("image_id"), *more]
    px = frame(spark, d, "px", by).select(*image, "y", "x", (F.col("pred") + 1).alias("seg_id"))
    keys = [c for c in px.columns if c not in ("y", "x", "seg_id")]
    kept = F.filter(F.collect_list("seg_id"), lambda s: (F.col("image_id") + s) % 7 != 0)
    doc = px.select(*keys, "seg_id").distinct().groupBy(*keys).agg(F.concat(kept, F.array(F.lit(99).cast("bigint"))).alias("seg_id")).withColumn("seg_id", F.explode("seg_id"))
    doc = doc.withColumn("category_id", (F.col("seg_id") - 1) % 11 * 3 + 1).withColumn("seq", F.col("seg_id")).withColumn("iscrowd", (F.col("seg_id") % 5 == 0).cast("int"))
    return px, doc


_DOC = [
    "sp as (select image_id, y, x, pred+1 as seg_id from px)",
    "dc as (select *, (seg_id-1)%11*3+1 as category_id, case when seg_id%5=0 then 1 else 0 end as iscrowd from (select distinct image_id, seg_id from sp where (image_id+seg_id)%7<>0 union all select distinct image_id, 99 from sp) z)",
]
Q["segment_id_differences"] = lambda s, d: ann.id_differences(*_segments(s, d))
SQL["segment_id_differences"] = oracle(("px",), "select image_id, seg_id, 'raster' as side from (select image_id, seg_id from sp except select image_id, seg_id from dc) a union all select image_id, seg_id, 'document' from (select image_id, seg_id from dc except select image_id, seg_id from sp) b", *_DOC)
Q["semantic_from_panoptic"] = lambda s, d: ann.semantic_from_panoptic(*_segments(s, d), frame(s, d, "categories")).groupBy("image_id", "label").agg(F.count("*").alias("area"))
SQL["semantic_from_panoptic"] = oracle(("px",), "select sp.image_id, coalesce((dc.category_id-1)//3, 255) as label, count(*) as area from sp left join dc using (image_id, seg_id) group by 1, 2", *_DOC)
Q["segment_objects"] = lambda s, d: ann.segment_objects(*_segments(s, d))
SQL["segment_objects"] = oracle(("px",), "select image_id, seg_id, category_id, count(*) as area, min(x) as x0, min(y) as y0, max(x)+1 as x1, max(y)+1 as y1 from sp join dc using (image_id, seg_id) where iscrowd=0 group by 1, 2, 3", *_DOC)
Q["class_objects"] = lambda s, d: ann.class_objects(_px(s, d), VOID)
SQL["class_objects"] = oracle(("px",), "select image_id, gt as label, count(*) as area, min(x) as x0, min(y) as y0, max(x)+1 as x1, max(y)+1 as y1 from px where gt<>255 group by 1, 2")

_ID = "(select id, row_number() over (order by pos)-1 as contiguous_id, isthing from categories)"
Q["contiguous_ids"] = lambda s, d: ann.contiguous_ids(frame(s, d, "categories"))
SQL["contiguous_ids"] = oracle(("categories",), f"select * from {_ID} z")
Q["to_contiguous"] = lambda s, d: ann.to_contiguous(_segments(s, d)[1].select("image_id", "seg_id", "category_id").withColumn("category_id", F.col("category_id") + F.when(F.col("image_id") % 13 == 0, 1).otherwise(0)), frame(s, d, "categories")).select("image_id", "seg_id", "category_id", "contiguous_id", "isthing")
SQL["to_contiguous"] = oracle(("px", "categories"), f"select d.image_id, d.seg_id, d.category_id, i.contiguous_id, i.isthing=1 as isthing from (select image_id, seg_id, category_id+case when image_id%13=0 then 1 else 0 end as category_id from dc) d left join {_ID} i on i.id=d.category_id", *_DOC)
Q["to_dataset_id"] = lambda s, d: ann.to_dataset_id(frame(s, d, "px").select("image_id", F.col("pred").alias("contiguous_id")).distinct(), frame(s, d, "categories"))
SQL["to_dataset_id"] = oracle(("px",), "select distinct image_id, pred as contiguous_id, pred*3+1 as category_id from px")
Q["id_map_things"] = lambda s, d: ann.mark_things(frame(s, d, "categories").select("pos", "name"), frame(s, d, "id_map").filter("sem_id <> 2"), "pos")
SQL["id_map_things"] = oracle(("categories", "id_map"), "select pos, name, case when pos in (select sem_id from id_map where sem_id<>2) then 1 else 0 end as isthing from categories")
Q["global_ids"] = lambda s, d: ann.global_numbers(_segments(s, d)[1].select("image_id", "seg_id"), "image_id", "seg_id", "id")
SQL["global_ids"] = oracle(("px",), "select image_id, seg_id, row_number() over (order by image_id, seg_id) as id from dc", *_DOC)


def id_map_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = frame(spark, d, "part").select((F.col("p_partkey") + 1).alias("line_no"), F.concat_ws("\t", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.col("p_brand")).alias("value"))
    return ann.read_id_map_lines(lines)


Q["id_map_later_line_wins"] = id_map_scan
SQL["id_map_later_line_wins"] = "select cast(p_size as bigint) as ins_id, max(p_partkey)-1 as sem_id from part group by 1"
