"""Registered queries over instance masks as runs and polygons: average precision of masks and boundaries, clipping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import coco, rasters, runs
from ..sources.scratch import land
from .box_queries import CURVES, greedy_sql, recursive, summary_sql
from .fixtures import LINES, dealt, frame, oracle

Q: dict = {}
SQL: dict[str, str] = {}
#: Area ranges for masks of these sizes, so that each has truth; the share of the diagonal that is a boundary.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 256.0), "medium": (256.0, 600.0), "large": (600.0, 1e10)}
RATIO = 0.01


def masks(spark: SparkSession, d: str, name: str, boxed: bool = True) -> DataFrame:
    """The fixture's masks as packed runs: a run for each row, two where the hole is; with boxes and area if `boxed`."""
    y, w = F.sequence("y0", F.col("y1") - 1), F.col("width")
    row = lambda v: F.when((v >= F.col("hy0")) & (v < F.col("hy1")), F.array(v * w + F.col("x0"), v * w + F.col("hx0"), v * w + F.col("hx1"), v * w + F.col("x1"))).otherwise(F.array(v * w + F.col("x0"), v * w + F.col("x1")))
    own = frame(spark, d, name)
    if not boxed:  # nothing else deals them
        own = dealt(own, "image_id", LINES)
    own = own.withColumn("runs", F.flatten(F.transform(y, row))).drop("x0", "y0", "x1", "y1", "hx0", "hy0", "hx1", "hy1")
    if not boxed:
        return own
    return runs.with_boxes(own).withColumn("area", runs.area(F.col("runs")))


_SHAPE = ("x0", "y0", "x1", "y1", "hx0", "hy0", "hx1", "hy1", "width")
#: Masks of a part in which they are ranked and meet by image and category.
MASKS = 131_072


def _runs_of(shapes: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The fixture's shapes, a box less a box, as the runs of all of them; a null shape has none."""
    numbers, given = runs.lists(shapes)
    x0, y0, x1, y1, hx0, hy0, hx1, hy1, width = numbers.reshape(-1, len(_SHAPE)).T
    high = np.maximum(y1 - y0, 0)
    of = np.repeat(np.arange(len(high)), high)
    y = np.arange(len(of)) - np.repeat(np.cumsum(high) - high, high) + y0[of]
    at = y * width[of]
    one = np.stack([at + x0[of], at + x1[of]], axis=1)
    cut = np.flatnonzero((y >= hy0[of]) & (y < hy1[of]))  # rows with a hole
    hole = np.stack([at[cut] + hx0[of[cut]], at[cut] + hx1[of[cut]]], axis=1)
    n = np.zeros(len(shapes), np.int64)
    n[given > 0] = 2 * (high + np.bincount(of[cut], minlength=len(high)))
    return np.insert(one.ravel(), np.repeat(2 * cut + 1, 2), hole.ravel()), n


def _shapes(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The fixture's masks as shapes, measured from their runs once; the lines are dealt before."""
    own = dealt(frame(spark, d, name), "image_id", LINES)
    whole = F.expr(" and ".join(f"{c} is not null" for c in _SHAPE))
    own = own.withColumn("shape", F.when(whole, F.array(*[F.col(c).cast("bigint") for c in _SHAPE]))).drop(*[c for c in _SHAPE if c != "width"])
    return land(runs.measured(own, "shape", _runs_of))


def _coco(spark: SparkSession, d: str, boundary: bool) -> DataFrame:
    gt, det = (_shapes(spark, d, n) for n in ("gt_mask", "det_mask"))
    parts = max(2, -(-max(gt.count(), det.count()) // MASKS))
    best = coco.ranked(det.repartition(parts, *coco.KEYS), areas=AREAS)
    near = rasters.boundary_distance(F.col("height"), F.col("width"), RATIO) if boundary else None
    pairs = runs.close_pairs(gt.repartition(parts, *coco.KEYS), best, min(coco.THRESHOLDS), distance=near, mask="shape", decode=_runs_of)
    return coco.by_category(coco.matched(pairs, best, gt, areas=AREAS), coco.truths(gt, AREAS), areas=AREAS)


def _rows(df: DataFrame) -> DataFrame:
    return df.select("category_id", "range", "t", "n_gt", *[F.round(c, 6).alias(c) for c in ("ap", "ar_1", "ar_10", "ar_100")])


Q["coco_segm_by_category"] = lambda s, d: _rows(_coco(s, d, False))
Q["coco_segm_summary"] = lambda s, d: coco.summary(_coco(s, d, False)).select("metric", F.round("value", 6).alias("value"))
Q["coco_boundary_by_category"] = lambda s, d: _rows(_coco(s, d, True))
Q["coco_boundary_summary"] = lambda s, d: coco.summary(_coco(s, d, True)).select("metric", F.round("value", 6).alias("value"))


# The SQL knows that a mask is a box less a box, and so is what erosion leaves of it: a smaller box less a larger hole.
def _rect(*boxes: tuple[str, str, str, str]) -> str:
    """Area that all boxes share."""
    x0, y0, x1, y1 = (",".join(b[k] for b in boxes) for k in range(4))
    one = len(boxes) == 1
    wide = f"({x1})-({x0})" if one else f"least({x1})-greatest({x0})"
    high = f"({y1})-({y0})" if one else f"least({y1})-greatest({y0})"
    return f"(greatest(0,{wide})*greatest(0,{high}))"


def _shape(t: str, d: str = "0") -> tuple:
    return tuple(f"{t}.{c}{s}{d}" for c, s in (("x0", "+"), ("y0", "+"), ("x1", "-"), ("y1", "-"))), tuple(f"{t}.{c}{s}{d}" for c, s in (("hx0", "-"), ("hy0", "-"), ("hx1", "+"), ("hy1", "+")))


def _size(s: tuple) -> str:
    return f"({_rect(s[0])}-{_rect(*s)})"


def _common(a: tuple, b: tuple) -> str:
    return f"({_rect(a[0], b[0])}-{_rect(a[0], b[0], a[1])}-{_rect(a[0], b[0], b[1])}+{_rect(a[0], b[0], a[1], b[1])})"


def _value(boundary: bool) -> str:
    a, b, c, e = _shape("a"), _shape("b"), _shape("a", "a.dist"), _shape("b", "a.dist")
    both = _common(a, b)
    mask = f"case when a.iscrowd=1 then {both}/{_size(b)} else {both}/({_size(a)}+{_size(b)}-{both}) end"
    if not boundary:
        return mask
    band = f"({both}-{_common(a, e)}-{_common(c, b)}+{_common(c, e)})"
    own, other = f"({_size(a)}-{_size(c)})", f"({_size(b)}-{_size(e)})"
    return f"least({mask}, case when a.iscrowd=1 then {band}/{other} else {band}/({own}+{other}-{band}) end)"


def _by_category(boundary: bool) -> list[str]:
    area = _size(_shape("m"))
    dist = f"greatest(1,cast(round_even({RATIO}*sqrt(m.height*m.height+m.width*m.width),0) as bigint)) as dist"
    return [
        f"gm as (select m.*, gt_id as ann_id, {area} as area, {dist} from gt_mask m)", f"dm as (select m.*, {area} as area from det_mask m)",
        *greedy_sql(",".join(f"('{n}',{lo!r},{hi!r})" for n, (lo, hi) in AREAS.items()), coco.THRESHOLDS, "gm", "dm", "area", _value(boundary)), *CURVES,
    ]


for _name, _boundary in (("segm", False), ("boundary", True)):
    SQL[f"coco_{_name}_by_category"] = recursive(oracle(("gt_mask", "det_mask"), 'select category_id, range_ as "range", t, n_gt, round(ap,6) as ap, round(ar_1,6) as ar_1, round(ar_10,6) as ar_10, round(ar_100,6) as ar_100 from bc', *_by_category(_boundary)))
    SQL[f"coco_{_name}_summary"] = recursive(oracle(("gt_mask", "det_mask"), summary_sql(), *_by_category(_boundary)))


def boundary_runs(spark: SparkSession, d: str) -> DataFrame:
    """Places of each truth mask's boundary, at a distance that follows the size of its image."""
    own = masks(spark, d, "gt_mask", boxed=False)
    own = own.select("image_id", "gt_id", "runs", "width", rasters.boundary_distance(F.col("height"), F.col("width"), RATIO).alias("_near"))
    return runs.boundary_areas(own, F.col("_near")).select("image_id", "gt_id", "area", "band")


Q["boundary_runs"] = boundary_runs
SQL["boundary_runs"] = oracle(
    ("gt_mask",), f"select image_id, gt_id, {_size(_shape('m'))} as area, {_size(_shape('m'))}-{_size(_shape('m', 'm.dist'))} as band from q m",
    f"q as (select *, greatest(1,cast(round_even({RATIO}*sqrt(height*height+width*width),0) as bigint)) as dist from gt_mask)",
)


# --- polygons ---------------------------------------------------------------------------------------------------------
_WINDOW = (100, 80, 300, 250)


def clipped_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Truth boxes as two triangles each, cut to a window: parts that remain, the area of the first part and of all."""
    first, second = F.array("x0", "y0", "x1", "y0", "x0", "y1"), F.array("x1", "y1", "x0", "y1", "x1", "y0")
    window = [F.lit(float(v)) for v in _WINDOW]
    cut = frame(spark, d, "gt_box").select("image_id", "ann_id", F.col("x1").alias("right"), G.clip_polygon(first, *window).alias("one"), G.clip_polygons(F.array(first, second), *window).alias("parts"))
    area = F.aggregate(F.transform("parts", G.polygon_area), F.lit(0.0), lambda a, v: a + v)
    low = F.array_min(F.flatten("parts"))
    return cut.select("image_id", "ann_id", "right", F.round(G.polygon_area(F.col("one")), 4).alias("one_area"), F.round(area, 4).alias("area"), (F.coalesce(low, F.lit(0.0)) >= 0).alias("inside"))


Q["clipped_polygons"] = clipped_polygons
SQL["clipped_polygons"] = oracle(
    ("gt_box",), """select image_id, ann_id, x1 as "right", round(greatest(0.0,case when b>a and f>e then (f-e)*(p-a)+(q-p)*((lp+lq)/2-e) else 0.0 end),4) as one_area,
 round(greatest(0.0,b-a)*greatest(0.0,least(y1,f)-e),4) as area, true as inside from t""",
    "w as (select *, greatest(x0,100.0) as a, least(x1,300.0) as b, greatest(y0,80.0) as e, 250.0 as f from gt_box)",
    # the slanted side falls from (x0, y1) to (x1, y0): above the window up to p, within it up to q
    "v as (select *, least(b,greatest(a,x0+(x1-x0)*(y1-f)/(y1-y0))) as p, least(b,greatest(a,x0+(x1-x0)*(y1-e)/(y1-y0))) as q from w)",
    "t as (select *, y1-(y1-y0)*(p-x0)/(x1-x0) as lp, y1-(y1-y0)*(q-x0)/(x1-x0) as lq from v)",
)
