"""Matching predictions to truth: cost join, optimal assignment, greedy score-ordered matching."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import activations as act
from ..functions import geometry as G
from ..sources.scratch import land
from . import boxes

WEIGHTS = {"cls": 4.0, "l1": 5.0, "giou": 2.0, "mask": 5.0, "dice": 5.0}


def _packed_points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(image_id, side, k, p, v): consecutive points of one mask as one row with lists of places and values."""
    for batch in batches:
        image, k = batch.column("image_id"), batch.column("k")
        change = np.ones(batch.num_rows, bool)
        for c in (image, k):
            v = c.to_numpy(zero_copy_only=False)
            change[1:] &= v[1:] == v[:-1]
        change[1:] = ~change[1:]
        first = np.flatnonzero(change)
        ends = pa.array(np.append(first, batch.num_rows).astype(np.int32))
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays(
            [image.take(at), batch.column("side").take(at), k.take(at), pa.ListArray.from_arrays(ends, batch.column("p")), pa.ListArray.from_arrays(ends, batch.column("v"))], names=["image_id", "side", "k", "p", "v"]
        )


def _pair_sums(table: pa.Table) -> pa.RecordBatch:
    """dice and bce of all pairs of the two sides' masks that share points, for the packed points of whole images."""
    table = table.combine_chunks()
    lengths = pc.list_value_length(table.column("p")).to_numpy().astype(np.int64)
    image, side, k = (np.repeat(table.column(c).to_numpy(), lengths) for c in ("image_id", "side", "k"))
    p, v = (pc.list_flatten(table.column(c)) for c in ("p", "v"))
    p, some, v = p.to_numpy(), pc.is_valid(v).to_numpy(), pc.fill_null(v, 0.0).to_numpy()
    place = np.empty(len(p), np.int64)  # the same number for the same point of an image
    order = np.lexsort((p, image))
    place[order] = np.cumsum(np.append(0, (np.diff(image[order]) != 0) | (np.diff(p[order]) != 0)))[: len(p)]
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    b = b[np.argsort(place[b], kind="stable")]
    low = np.searchsorted(place[b], place[a], "left")
    n = np.searchsorted(place[b], place[a], "right") - low
    i = np.repeat(np.arange(len(a)), n)
    j = b[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]]
    x = v[a]
    with np.errstate(over="ignore"):
        prob = 1.0 / (1.0 + np.exp(-x))
    rest = np.maximum(x, 0.0) + np.log1p(np.exp(-np.abs(x)))  # what the cross-entropy has beside x * t
    left, right, t = some[a][i], some[j], v[j]
    order = np.lexsort((k[j], k[a][i], image[j]))
    keys = [c[order] for c in (image[j], k[a][i], k[j])]
    first = np.flatnonzero(np.append(True, np.any([np.diff(c) != 0 for c in keys], axis=0))) if len(order) else np.zeros(0, np.int64)
    add = lambda w: np.add.reduceat(w[order].astype(float), first) if len(first) else np.zeros(0)
    both, prob = left & right, prob[i]
    hits, count = add(prob * t * both), add(both)
    with np.errstate(invalid="ignore", divide="ignore"):
        dice = 1.0 - (2.0 * hits + 1.0) / (add(prob * left) + add(t) + 1.0)
        bce = add((rest[i] - x[i] * t) * both) / count
    empty = count == 0  # no point where both have a value
    return pa.RecordBatch.from_arrays([*(pa.array(c[first], pa.int64()) for c in keys), pa.array(dice, mask=empty), pa.array(bce, mask=empty)], names=["image_id", "q", "gt_id", "dice", "bce"])


def _costs_of_images(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by image, worked off in whole images of some thousand masks together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        image = batch.column("image_id").to_numpy()
        new = np.append(0, np.flatnonzero(np.diff(image)) + 1)  # where images begin
        some = new[np.searchsorted(new, np.arange(0, batch.num_rows, 4096), "right") - 1]
        begun = bool(held) and held[-1].column("image_id")[-1].as_py() != image[0]
        cuts = [c for c in np.unique(np.append(some, new[-1])).tolist() if c or begun]
        last = 0
        for cut in cuts:
            held.append(batch.slice(last, cut - last))
            yield _pair_sums(pa.Table.from_batches(held))
            held, last = [], cut
        held.append(batch.slice(last))
    if held:
        yield _pair_sums(pa.Table.from_batches(held))


def mask_pair_costs(pred_points: DataFrame, gt_points: DataFrame) -> DataFrame:
    """(image_id, q, gt_id, dice, bce) from logits (image_id, p, q, logit) and truth (image_id, p, gt_id, t) at points.

    Pairs meet on the point. Consecutive points of a mask are packed into one row before the one shuffle, by image, and the
    pairs of an image's points exist only inside a batch of some images; an image is bounded by the model's queries and points.
    A missing logit or truth counts as in SQL's sums; points without a mask's number are left out."""

    def side(df: DataFrame, number: int, key: str, value: str) -> DataFrame:
        rows = df.select(*[F.col(c).cast("bigint").alias(n) for c, n in (("image_id", "image_id"), (key, "k"), ("p", "p"))], F.lit(number).alias("side"), F.col(value).cast("double").alias("v"))
        return rows.filter("image_id is not null and p is not null and k is not null")

    packed = side(pred_points, 0, "q", "logit").unionByName(side(gt_points, 1, "gt_id", "t")).mapInArrow(_packed_points, "image_id bigint, side int, k bigint, p array<bigint>, v array<double>")
    return packed.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(_costs_of_images, "image_id bigint, q bigint, gt_id bigint, dice double, bce double")


def match_costs(query_cls: DataFrame, query_box: DataFrame, gt: DataFrame, mask_pairs: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(image_id, q, gt_id, cost). gt: image_id, gt_id, label, cx, cy, w, h (normalised); mask_pairs: dice and bce."""
    q = query_box.select("image_id", "q", *[F.col(c).alias("q_" + c) for c in ("cx", "cy", "w", "h")])
    t = gt.select("image_id", "gt_id", "label", *[F.col(c).alias("t_" + c) for c in ("cx", "cy", "w", "h")])
    cls = query_cls.select("image_id", "q", F.col("c").alias("label"), act.focal_class_cost(F.col("logit")).alias("cls"))
    met = q.join(t, "image_id").join(cls, ["image_id", "q", "label"])
    a, b = ([F.col(m + c) for c in ("cx", "cy", "w", "h")] for m in ("q_", "t_"))
    cost = F.lit(weights["cls"]) * F.col("cls") + F.lit(weights["l1"]) * G.l1(a, b) - F.lit(weights["giou"]) * G.giou(G.cxcywh_to_xyxy(a), G.cxcywh_to_xyxy(b))
    if mask_pairs is not None:
        met = met.join(mask_pairs, ["image_id", "q", "gt_id"])
        cost = cost + F.lit(weights["mask"]) * F.col("bce") + F.lit(weights["dice"]) * F.col("dice")
    return met.select("image_id", "q", "gt_id", cost.alias("cost"))


def shortest_augmenting_paths(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a least-cost assignment of all rows (rows <= columns), by dual potentials."""
    n, m = cost.shape
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while row_of[j]:
            used[j] = True
            free = ~used[1:]
            reduced = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            closer = free & (reduced < least[1:])
            least[1:][closer], way[1:][closer] = reduced[closer], j
            nxt = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            step = least[nxt]
            u[row_of[used]] += step
            v[used] -= step
            least[1:][free] -= step
            j = nxt
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    out = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (image_id, q, gt_id, cost) sorted by the first three: the pairs of each image; many images share a batch."""
    held = None

    def solve(table: pa.Table) -> pa.RecordBatch:
        image, q, gt, cost = (table.column(c).to_numpy() for c in ("image_id", "q", "gt_id", "cost"))
        borders = np.append(np.flatnonzero(np.diff(image, prepend=image[0] - 1)), len(image))
        rows = []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            qs, gs = np.unique(q[a:b]), np.unique(gt[a:b])
            c = np.full((len(qs), len(gs)), np.nan)
            c[np.searchsorted(qs, q[a:b]), np.searchsorted(gs, gt[a:b])] = cost[a:b]
            flip = len(qs) > len(gs)
            cols = shortest_augmenting_paths(c.T if flip else c)
            qi, gi = (cols, np.arange(len(cols))) if flip else (np.arange(len(cols)), cols)
            rows.append((np.full(len(cols), image[a]), qs[qi], gs[gi], c[qi, gi]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["image_id", "q", "gt_id", "cost"])

    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        image = table.column("image_id").to_numpy()
        if not len(image):
            continue
        cut = int(np.searchsorted(image, image[-1]))  # the last image may go on in the next batch
        if cut:
            yield solve(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield solve(held)


def assign(costs: DataFrame) -> DataFrame:
    """The least-cost one-to-one matching of each image: min(queries, truths) pairs of (image_id, q, gt_id, cost).

    Every query of an image needs a cost with each of its truths. An image is bounded by the queries of the model, not
    by the data; the images of a partition are solved one after another from sorted batches."""
    rows = costs.select(*[F.col(c).cast("bigint").alias(c) for c in ("image_id", "q", "gt_id")], F.col("cost").cast("double").alias("cost"))
    return rows.repartition("image_id").sortWithinPartitions("image_id", "q", "gt_id").mapInArrow(_solved, "image_id long, q long, gt_id long, cost double")


def box_pairs(gt: DataFrame, det: DataFrame, on: Sequence[str] = ("image_id", "category_id"), grid: float | None = None) -> DataFrame:
    """(keys, det_id, score, gt_id, v, crowd) of overlapping boxes; v is IoU, or for a crowd truth intersection over
    detection area. gt: keys, gt_id, x0..y1, iscrowd; det: keys, det_id, x0..y1, score. Boxes of equal keys meet in one join;
    where keys may be crowded, `grid` makes those meet by cells."""
    on = list(on)
    d, g = det.select(*on, "det_id", "score", *boxes.XYXY), gt.select(*on, "gt_id", "iscrowd", *boxes.XYXY)
    met = boxes.pairs(d, g, on).filter(G.intersection(G.columns("a_"), G.columns("b_")) > 0) if grid is None else boxes.overlapping_pairs(d, g, on, grid)
    a, b, crowd = G.columns("a_"), G.columns("b_"), F.col("b_iscrowd") == 1
    value = F.when(crowd, G.intersection(a, b) / G.area(a)).otherwise(G.iou(a, b, 0.0))
    return met.select(*on, F.col("a_det_id").alias("det_id"), F.col("a_score").alias("score"), F.col("b_gt_id").alias("gt_id"), F.round(value, 12).alias("v"), crowd.alias("crowd"))


def mask_pairs(gt_px: DataFrame, det_px: DataFrame, det: DataFrame, on: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """The same from mask pixels: gt_px (keys, gt_id, y, x), det_px (keys, det_id, y, x), det (keys, det_id, score).

    Pixels meet once on their place; counts leave the join. Boundary pairs: give bands from rasters.boundary_band."""
    on = list(on)
    inter = det_px.join(gt_px, [*on, "y", "x"]).groupBy(*on, "det_id", "gt_id").agg(F.count("*").alias("n"))
    g, d = gt_px.groupBy(*on, "gt_id").agg(F.count("*").alias("g")), det_px.groupBy(*on, "det_id").agg(F.count("*").alias("d"))
    met = inter.join(g, [*on, "gt_id"]).join(d, [*on, "det_id"]).join(det.select(*on, "det_id", "score"), [*on, "det_id"])
    return met.select(*on, "det_id", "score", "gt_id", F.round(F.col("n") / (F.col("g") + F.col("d") - F.col("n")), 12).alias("v"), F.lit(False).alias("crowd"))


def threshold_bits(v: Column, thresholds: Sequence[float]) -> Column:
    """Bit i is set if v reaches the i-th threshold."""
    return sum((F.when(v >= float(t), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(thresholds)), F.lit(0)).cast("bigint")


def match_rounds(pairs: DataFrame, on: Sequence[str], unrolled: int = 1) -> DataFrame:
    """(keys, det_id, gt_id, ignore, bits): the greedy matching of many settings at once, one bit a setting (62 at most).

    pairs: keys, det_id, score, gt_id, v, crowd, `left` (settings in which the pair counts), `skip` (those in which the
    truth is to be ignored). In each setting detections by falling score (then det_id) take the free truth of highest v
    (then gt_id), truths to ignore last; a crowd stays free. That is settled in rounds: a pair is final where the truth is
    the detection's best one left and the detection the first one left of the truth, which is what running ORs over
    the two orders show; what it rules out is dropped. A round settles at least the first detection that is left, and most pairs
    have no rivals and go in the first one. Rows are dealt by the keys once a landing, `unrolled` rounds need no further shuffle."""
    on = list(on)
    bits = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    det, gt = Window.partitionBy(*on, "det_id"), Window.partitionBy(*on, "gt_id")
    before = (Window.unboundedPreceding, -1)
    best = det.orderBy("ignore", F.col("v").desc(), "gt_id").rowsBetween(*before)
    first = gt.orderBy(F.col("score").desc(), "det_id", "ignore").rowsBetween(*before)
    split = F.explode(F.array(F.struct(F.lit(False).alias("ignore"), F.col("left").bitwiseAND(F.bitwise_not("skip")).alias("left")), F.struct(F.lit(True).alias("ignore"), F.col("left").bitwiseAND(F.col("skip")).alias("left"))))
    rest = pairs.select(*on, "det_id", "score", "gt_id", "v", "crowd", split.alias("s")).select(*on, "det_id", "score", "gt_id", "v", "crowd", "s.*").filter("left <> 0")
    out = None
    while True:
        rest, done = rest.repartition(*on).withColumn("bits", F.lit(0).cast("bigint")), None
        for _ in range(unrolled):
            free = F.bitwise_not(bits(F.bit_or("left").over(best))).bitwiseAND(F.when(F.col("crowd"), F.lit(-1).cast("bigint")).otherwise(F.bitwise_not(bits(F.bit_or("left").over(first)))))
            rest = rest.withColumn("hit", F.col("left").bitwiseAND(free))
            gone = F.bit_or("hit").over(det).bitwiseOR(F.when(F.col("crowd"), F.lit(0).cast("bigint")).otherwise(F.bit_or("hit").over(gt)))
            rest = rest.select(*on, "det_id", "score", "gt_id", "v", "crowd", "ignore", F.col("left").bitwiseAND(F.bitwise_not(gone)).alias("left"), F.col("bits").bitwiseOR(F.col("hit")).alias("bits"))
        rest = land(rest.filter("left <> 0 or bits <> 0"))
        done = rest.filter("bits <> 0").select(*on, "det_id", "gt_id", "ignore", "bits")
        out = done if out is None else out.unionByName(done)
        rest = rest.filter("left <> 0").drop("bits")
        if rest.isEmpty():
            return out


def greedy_match(pairs: DataFrame, det: DataFrame, thresholds: Sequence[float], on: Sequence[str] = ("image_id", "category_id")) -> DataFrame:
    """det rows for each threshold with gt_id, tp and ignored: by falling score each takes the free truth of highest v >= t.

    pairs: as from box_pairs or runs.mask_pairs; det: keys, det_id, score. Truths to ignore (column `ignore` of pairs; else the
    crowds) are tried last, and crowds may absorb several detections. Settled in rounds, see match_rounds."""
    on = list(on)
    skip = F.when(F.col("ignore" if "ignore" in pairs.columns else "crowd"), F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    hits = match_rounds(pairs.withColumns({"left": threshold_bits(F.col("v"), thresholds), "skip": skip}), on)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(thresholds)])).alias("e")
    hits = hits.select("*", each).filter(F.expr("shiftright(bits, e.i) & 1") == 1).select(*on, F.col("e.t").alias("t"), "det_id", "gt_id", "ignore")
    every = det.select(*on, "det_id", "score", each).select(*on, "det_id", "score", F.col("e.t").alias("t"))
    out = every.join(hits, [*on, "t", "det_id"], "left")
    return out.withColumn("tp", F.coalesce((~F.col("ignore")).cast("int"), F.lit(0))).withColumn("ignored", F.coalesce("ignore", F.lit(False))).drop("ignore")


def unmatched(all_rows: DataFrame, matched: DataFrame, on: list[str]) -> DataFrame:
    return all_rows.join(matched, on, "left_anti")


def gather(matches: DataFrame, preds: DataFrame, gt: DataFrame) -> DataFrame:
    """Matched pairs with both sides' columns: preds by (image_id, q), truth by (image_id, gt_id)."""
    p = preds.select("image_id", "q", *[F.col(c).alias("p_" + c) for c in preds.columns if c not in ("image_id", "q")])
    t = gt.select("image_id", "gt_id", *[F.col(c).alias("t_" + c) for c in gt.columns if c not in ("image_id", "gt_id")])
    return matches.join(p, ["image_id", "q"]).join(t, ["image_id", "gt_id"])


def box_losses(pairs: DataFrame, things_below: int | None = None, label: str = "t_label") -> DataFrame:
    """L1 and 1 - GIoU summed over matched pairs and divided by their number (1 at least); optionally things only."""
    a, b = ([F.col(m + c) for c in ("cx", "cy", "w", "h")] for m in ("p_", "t_"))
    kept = F.lit(True) if things_below is None else F.col(label) < things_below
    n = F.greatest(F.lit(1), F.count("*"))
    return pairs.agg(
        (F.sum(F.when(kept, G.l1(a, b)).otherwise(0.0)) / n).alias("loss_bbox"),
        (F.sum(F.when(kept, 1.0 - G.giou(G.cxcywh_to_xyxy(a), G.cxcywh_to_xyxy(b), 0.0)).otherwise(0.0)) / n).alias("loss_giou"),
    )


def associate_frames(boxes_by_frame: DataFrame, least: float = 0.5) -> DataFrame:
    """Each box of a frame with the best overlapping box of the frame before in its stream, IoU >= least.

    boxes_by_frame: stream_id, frame_idx, det_id, x0..y1. One self equi-join on (stream, frame)."""
    before = boxes_by_frame.withColumn("frame_idx", F.col("frame_idx") + 1)
    met = boxes.pairwise_iou(boxes_by_frame, before, ["stream_id", "frame_idx"]).filter(F.col("iou") >= least)
    w = Window.partitionBy("stream_id", "frame_idx", "a_det_id").orderBy(F.col("iou").desc(), "b_det_id")
    return met.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("stream_id", "frame_idx", F.col("a_det_id").alias("det_id"), F.col("b_det_id").alias("before_id"), "iou")
