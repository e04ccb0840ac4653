"""Model outputs to results: top-k instances, fused semantic maps, merged panoptic segments.

query_cls (image_id, q, c, logit), query_mask (image_id, q, y, x, logit), query_box (image_id, q, cx, cy, w, h)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import activations as act
from ..functions import geometry as G
from .annotations import things as only_things


def topk_pairs(query_cls: DataFrame, k: int = 100) -> DataFrame:
    """The k best (query, class) pairs of each image by sigmoid score; ties to the smaller query, then class."""
    w = Window.partitionBy("image_id").orderBy(F.col("logit").desc(), "q", "c")
    return query_cls.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("score", act.sigmoid(F.col("logit")))


def mask_quality(query_mask: DataFrame) -> DataFrame:
    """Mean sigmoid over the pixels with logit > 0 of each query, and their number."""
    on = F.col("logit") > 0
    return query_mask.groupBy("image_id", "q").agg(
        (F.sum(F.when(on, act.sigmoid(F.col("logit"))).otherwise(0.0)) / (F.sum(on.cast("int")) + 1e-6)).alias("quality"), F.sum(on.cast("bigint")).alias("mask_area")
    )


def topk_instances(query_cls: DataFrame, query_mask: DataFrame, query_box: DataFrame, k: int = 100, things: DataFrame | None = None, focus_on_box: bool = False, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """The k best pairs with box (xyxy, absolute) and score times mask quality; `things` (c, isthing) filters after the top k."""
    top = topk_pairs(query_cls, k)
    if things is not None:
        top = only_things(top, things, "c", "c")
    quality = mask_quality(query_mask)
    factor = F.lit(1.0) if focus_on_box else F.col("quality")
    box = G.scaled(G.cxcywh_to_xyxy([F.col(c) for c in ("cx", "cy", "w", "h")]), F.lit(width), F.lit(height))
    return top.join(quality, ["image_id", "q"]).join(query_box, ["image_id", "q"]).select(
        "image_id", "q", "c", "rank", (F.col("score") * factor).alias("score"), "mask_area", *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))]
    )


def class_scores(query_cls: DataFrame, mode: str = "sigmoid", temperature: float = 0.06) -> DataFrame:
    """query_cls with `p`: sigmoid; softmax_t = softmax(sigmoid / T); ce = softmax without its last class."""
    if mode == "sigmoid":
        return query_cls.withColumn("p", act.sigmoid(F.col("logit")))
    if mode == "softmax_t":
        return act.softmax_over(query_cls, ["image_id", "q"], act.sigmoid(F.col("logit")), "p", temperature)
    last = F.max("c").over(Window.partitionBy("image_id", "q"))
    return act.softmax_over(query_cls, ["image_id", "q"], F.col("logit"), "p").withColumn("_l", last).filter("c < _l").drop("_l")


def _by_image(query_rows: DataFrame, name: str, *values: str) -> DataFrame:
    """(image_id, name): the rows of an image's queries as one map from q, as many as the model has queries.

    Pixels that meet it go by image_id alone and stay in place for all groups within an image; the maps are the hashed side."""
    entry = F.struct("q", F.struct(*values))
    return query_rows.groupBy("image_id").agg(F.map_from_entries(F.collect_list(entry)).alias(name)).hint("shuffle_hash")


def class_sums(query_cls: DataFrame, query_mask: DataFrame, classes: Sequence[int] | None = None, mode: str = "sigmoid", temperature: float = 0.06, eps: float = 0.0) -> tuple[DataFrame, list[int]]:
    """Per pixel one column s0, s1, ... for each class: the sum over queries of class score times mask probability.

    The classes of a query lie side by side, so a mask pixel meets them once, and pixels are shuffled once, by image. Without
    `classes` those of query_cls are asked for first; they are as many as the model has. eps > 0 leaves out weaker cells."""
    if classes is None:
        classes = sorted(r["c"] for r in query_cls.select("c").distinct().collect())
    scores = class_scores(query_cls, mode, temperature).groupBy("image_id", "q")
    wide = scores.agg(*[F.sum(F.when(F.col("c") == c, F.col("p")).otherwise(0.0)).alias(f"p{i}") for i, c in enumerate(classes)])
    scored = _by_image(wide, "_of", *[f"p{i}" for i in range(len(classes))])
    mask = query_mask.select("image_id", "q", "y", "x", act.sigmoid(F.col("logit")).alias("m")).filter(F.col("m") >= eps)
    sums = [F.sum(F.col(f"_p.p{i}") * F.col("m")).alias(f"s{i}") for i in range(len(classes))]
    met = mask.join(scored, "image_id").select("image_id", "y", "x", "m", F.try_element_at("_of", F.col("q")).alias("_p")).filter("_p is not null")
    return met.groupBy("image_id", "y", "x").agg(*sums), list(classes)


def semantic_scores(query_cls: DataFrame, query_mask: DataFrame, classes: Sequence[int] | None = None, **how) -> DataFrame:
    """(image_id, y, x, c, score) of `class_sums`."""
    wide, classes = class_sums(query_cls, query_mask, classes, **how)
    each = F.array(*[F.struct(F.lit(c).cast("bigint").alias("c"), F.col(f"s{i}").alias("score")) for i, c in enumerate(classes)])
    return wide.select("image_id", "y", "x", F.inline(each))


def semantic_labels(query_cls: DataFrame, query_mask: DataFrame, classes: Sequence[int] | None = None, decimals: int | None = None, **how) -> DataFrame:
    """The best class of each pixel as `label`; ties to the smaller class. `decimals` rounds scores before the comparison."""
    wide, classes = class_sums(query_cls, query_mask, classes, **how)
    if decimals is not None:
        wide = wide.select("image_id", "y", "x", *[F.round(f"s{i}", decimals).alias(f"s{i}") for i in range(len(classes))])
    cols = [F.col(f"s{i}") for i in range(len(classes))]
    label = F.lit(classes[-1])
    best = F.greatest(*cols) if len(cols) > 1 else cols[0]
    for c, s in list(zip(classes, cols))[-2::-1]:
        label = F.when(s == best, F.lit(c)).otherwise(label)
    return wide.select("image_id", "y", "x", label.cast("bigint").alias("label"))


def argmax_label(scores: DataFrame, decimals: int | None = None) -> DataFrame:
    """The best class of each pixel of (image_id, y, x, c, score); ties to the smaller class."""
    s = F.col("score") if decimals is None else F.round("score", decimals)
    return scores.groupBy("image_id", "y", "x").agg(F.max_by("c", F.struct(s, -F.col("c"))).alias("label"))


def tta_average(views: DataFrame, width: Column) -> DataFrame:
    """Mean of class maps over views; flipped views are mirrored back first. views: image_id, view, flipped, y, x, c, score."""
    back = views.withColumn("x", F.when(F.col("flipped"), width - 1 - F.col("x")).otherwise(F.col("x")))
    return back.groupBy("image_id", "y", "x", "c").agg(F.avg("score").alias("score"))


_QUERY_BITS = 20


def panoptic_merge(query_cls: DataFrame, query_mask: DataFrame, things: DataFrame, mask_threshold: float, overlap_threshold: float, transform_eval: bool = True, temperature: float = 0.06, no_object: int | None = None, decimals: int = 9) -> tuple[DataFrame, DataFrame]:
    """(pixels, segments) of a panoptic result; things: (c, isthing).

    Queries stay whose best sigmoid score passes the threshold (and whose class is an object). With transform_eval
    score and class come from softmax(sigmoid / T). Each pixel goes to the query of best score times mask probability,
    at `decimals` (12 at most), ties to the smaller query (below 2**20).
    A query survives if enough of its mask is won; stuff of one class merges into its first survivor, and ids run in
    the order of leaders. Painted are pixels won with probability at least one half; others are 0.
    Value, query and mask bit of a cell are one number, so the winner of a pixel is a plain maximum. Cells are shuffled once,
    by image; what is known of an image's queries comes to them as one map."""
    best = F.max_by(F.struct("c", "p"), F.struct(F.col("p"), -F.col("c")))
    kept = class_scores(query_cls).groupBy("image_id", "q").agg(best.alias("b")).filter(F.col("b.p") > mask_threshold)
    if no_object is not None:
        kept = kept.filter(F.col("b.c") != no_object)
    if transform_eval:
        soft = class_scores(query_cls.join(kept.select("image_id", "q"), ["image_id", "q"]), "softmax_t", temperature)
        kept = soft.groupBy("image_id", "q").agg(best.alias("b"))
    kept = kept.select("image_id", "q", F.col("b.c").alias("category_id"), F.col("b.p").alias("score"))
    m, most = act.sigmoid(F.col("logit")), (1 << _QUERY_BITS) - 1
    value = F.round(F.round(F.col("score") * F.col("m"), decimals) * 10**decimals).cast("bigint")
    cells = query_mask.join(_by_image(kept, "_of", "score"), "image_id", "left").select("image_id", "q", "y", "x", m.alias("m"), F.try_element_at("_of", F.col("q"))["score"].alias("score"))
    on = (F.col("m") >= 0.5).cast("bigint")
    won = cells.groupBy("image_id", "y", "x").agg(F.max(F.when(F.col("score").isNotNull(), value * 2 * (most + 1) + (most - F.col("q")) * 2 + on)).alias("w"))
    won = won.select("image_id", "y", "x", (most - F.floor(F.pmod("w", F.lit(2 * (most + 1))) / 2)).cast("bigint").alias("q"), (F.col("w") % 2 == 1).alias("on"))
    mine = won.filter("q is not null").groupBy("image_id", "q").agg(F.count("*").alias("mask_area"), F.count_if("on").alias("final_area"))
    whole = query_mask.filter(m >= 0.5).groupBy("image_id", "q").agg(F.count("*").alias("original_area"))
    met = mine.withColumnsRenamed({"image_id": "_i", "q": "_q"})  # null-safe, so that this side reads the shuffle of cells that the pixels read
    alive = (
        kept.join(met, F.col("image_id").eqNullSafe(F.col("_i")) & F.col("q").eqNullSafe(F.col("_q"))).drop("_i", "_q").join(whole, ["image_id", "q"]).filter("final_area > 0").filter(F.col("mask_area") / F.col("original_area") >= overlap_threshold)
        .join(things.select(F.col("c").alias("category_id"), "isthing"), "category_id")
    )
    leader = F.when(F.col("isthing") == 1, F.col("q")).otherwise(F.min("q").over(Window.partitionBy("image_id", "category_id")))
    led = alive.withColumn("leader", leader).withColumn("seg_id", F.dense_rank().over(Window.partitionBy("image_id").orderBy("leader")).cast("bigint"))
    segments = led.groupBy("image_id", "seg_id").agg(F.min("category_id").alias("category_id"), F.min("isthing").alias("isthing"), F.sum("final_area").alias("area"))
    pixels = won.join(_by_image(led, "_led", "seg_id"), "image_id", "left")
    seg = F.when(F.col("on"), F.try_element_at("_led", F.col("q"))["seg_id"])
    return pixels.select("image_id", "y", "x", F.coalesce(seg, F.lit(0)).cast("bigint").alias("seg_id")), segments
