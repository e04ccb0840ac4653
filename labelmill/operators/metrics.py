"""Evaluation: panoptic quality, confusion metrics, average precision, latency, match quality, gates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import activations as act
from . import ordering


def confusion(px: DataFrame, ignore: int, void_index: int, gt: str = "gt", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """(pred, gt, n): ignored truth counts under void_index. `weight` holds pixels per row for run pairs."""
    n = F.count("*") if weight is None else F.sum(weight)
    return px.groupBy(F.col(pred).alias("pred"), F.when(F.col(gt) == ignore, void_index).otherwise(F.col(gt)).alias("gt")).agg(n.alias("n"))


def overlaps(px: DataFrame, gt: str = "gt", pred: str = "pred") -> DataFrame:
    return px.groupBy("image_id", F.col(gt).alias("gt"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def pq_stats(overlap: DataFrame, void: int) -> DataFrame:
    """(category_id, iou, tp, fp, fn) from overlaps (image_id, gt, pred, n); every label of an image is one segment.

    A pair matches with equal category and IoU > 0.5, void pixels taken out of the union. Unmatched truth is a miss;
    an unmatched prediction a false alarm unless more than half of it lies on void. Pixels are aggregated once; all
    else works on segments."""
    area = F.sum("n")
    pred = overlap.groupBy("image_id", "pred").agg(area.alias("pred_area"), F.sum(F.when(F.col("gt") == void, F.col("n")).otherwise(0)).alias("void_area"))
    truth = overlap.filter(F.col("gt") != void).groupBy("image_id", "gt").agg(area.alias("gt_area"))
    same = overlap.filter((F.col("gt") == F.col("pred")) & (F.col("gt") != void)).select("image_id", F.col("gt").alias("category_id"), "n")
    pairs = (
        same.join(pred.withColumnRenamed("pred", "category_id"), ["image_id", "category_id"]).join(truth.withColumnRenamed("gt", "category_id"), ["image_id", "category_id"])
        .withColumn("iou", F.col("n") / (F.col("pred_area") + F.col("gt_area") - F.col("n") - F.col("void_area")))
        .filter("iou > 0.5").select("image_id", "category_id", "iou")
    )
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    hits = pairs.select("category_id", "iou", one.alias("tp"), zero.alias("fp"), zero.alias("fn"))
    misses = truth.withColumnRenamed("gt", "category_id").join(pairs, ["image_id", "category_id"], "left_anti").select("category_id", F.lit(0.0).alias("iou"), zero.alias("tp"), zero.alias("fp"), one.alias("fn"))
    alarms = (
        pred.withColumnRenamed("pred", "category_id").filter((F.col("category_id") != void) & (F.col("void_area") * 2 <= F.col("pred_area")))
        .join(pairs, ["image_id", "category_id"], "left_anti").select("category_id", F.lit(0.0).alias("iou"), zero.alias("tp"), one.alias("fp"), zero.alias("fn"))
    )
    sums = [F.sum(c).alias(c) for c in ("iou", "tp", "fp", "fn")]
    return hits.unionByName(misses).unionByName(alarms).groupBy("category_id").agg(*sums)


def unknown_predictions(overlap: DataFrame, categories: DataFrame, void: int) -> DataFrame:
    """(image_id, pred, pixels) of predicted segments that are void or of no known category: results that break the rules."""
    pred = overlap.groupBy("image_id", "pred").agg(F.sum("n").alias("pixels"))
    known = categories.select(F.col("category_id").alias("pred")).filter(F.col("pred") != void)
    return pred.join(known, "pred", "left_anti").select("image_id", "pred", "pixels")


def pq_classes(stats: DataFrame) -> DataFrame:
    """pq, sq and rq of each category that occurs."""
    weight = F.col("tp") + F.col("fp") / 2 + F.col("fn") / 2
    return stats.filter(F.col("tp") + F.col("fp") + F.col("fn") > 0).select(
        "category_id", "tp", "fp", "fn", (F.col("iou") / weight).alias("pq"),
        F.when(F.col("tp") > 0, F.col("iou") / F.col("tp")).otherwise(0.0).alias("sq"), (F.col("tp") / weight).alias("rq"),
    )


def pq_summary(stats: DataFrame, categories: DataFrame) -> DataFrame:
    """Mean pq, sq, rq and number of categories, for all and for stuff; categories: (category_id, isthing)."""
    classes = pq_classes(stats).join(categories, "category_id")
    scoped = classes.withColumn("scope", F.explode(F.when(F.col("isthing") == 0, F.array(F.lit("All"), F.lit("Stuff"))).otherwise(F.array(F.lit("All")))))
    return scoped.groupBy("scope").agg(F.avg("pq").alias("pq"), F.avg("sq").alias("sq"), F.avg("rq").alias("rq"), F.count("*").alias("n"))


def report(summary: DataFrame) -> DataFrame:
    """The printed form: shares times 100 with one decimal."""
    return summary.select("scope", *[F.round(100 * F.col(c), 1).alias(c) for c in ("pq", "sq", "rq")], "n")


def class_iou(conf: DataFrame, void_index: int) -> DataFrame:
    """Per class: tp, truth and predicted pixels; the void row and column are cut off first."""
    inner = conf.filter((F.col("gt") != void_index) & (F.col("pred") != void_index))
    both = inner.select(F.col("gt").alias("label"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("gt_n"), F.lit(0).alias("pred_n")).unionByName(
        inner.select(F.col("pred").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("gt_n"), F.col("n").alias("pred_n"))
    )
    return both.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("gt_n").alias("gt_n"), F.sum("pred_n").alias("pred_n"))


def miou(conf: DataFrame, void_index: int, denominator: str = "reference") -> DataFrame:
    """miou and macc. `reference` sums IoU over classes with truth and divides by the classes seen in truth or
    prediction; `standard` divides by the classes with truth."""
    c = class_iou(conf, void_index)
    iou = F.col("tp") / (F.col("gt_n") + F.col("pred_n") - F.col("tp"))
    seen = F.col("gt_n") + F.col("pred_n") > 0 if denominator == "reference" else F.col("gt_n") > 0
    return c.agg(
        (F.sum(F.when(F.col("gt_n") > 0, iou)) / F.sum(seen.cast("int"))).alias("miou"),
        F.avg(F.when(F.col("gt_n") > 0, F.col("tp") / F.col("gt_n"))).alias("macc"),
    )


def semantic_suite(conf: DataFrame, void_index: int) -> DataFrame:
    """mIoU, frequency-weighted IoU, mean and pixel accuracy."""
    c = class_iou(conf, void_index).crossJoin(F.broadcast(class_iou(conf, void_index).agg(F.sum("gt_n").alias("all_n"))))
    iou = F.col("tp") / (F.col("gt_n") + F.col("pred_n") - F.col("tp"))
    has = F.col("gt_n") > 0
    return c.agg(
        F.avg(F.when(has, iou)).alias("miou"), F.sum(F.when(has, iou * F.col("gt_n") / F.col("all_n"))).alias("fwiou"),
        F.avg(F.when(has, F.col("tp") / F.col("gt_n"))).alias("macc"), (F.sum("tp") / F.max("all_n")).alias("pacc"),
    )


def precision_recall(matches: DataFrame, keys: list[str], ties: tuple[str, ...] = ("det_id",)) -> DataFrame:
    """Running precision and recall by falling score, with the non-increasing precision envelope.

    matches: keys, score, tp (0/1), n_gt and the columns that order ties. Rows lie in range partitions of the order;
    counts run within a partition and over the partitions of a key, so no task holds a whole key."""
    order = [F.col("score").desc(), *[F.col(c) for c in ties]]
    rows = ordering.ranged(matches, *[F.col(k) for k in keys], *order)
    totals = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_rows"), F.sum("tp").alias("_hits"))
    start = ordering.small(ordering.before_parts(totals, keys, {"_n0": "_rows", "_tp0": "_hits"}))  # one row a key and part
    inside = Window.partitionBy(*keys, "_part")
    w = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.join(start, [*keys, "_part"]).withColumns({"_tp": F.col("_tp0") + F.sum("tp").over(w), "_n": F.col("_n0") + F.count("*").over(w)})
    run = run.withColumns({"recall": F.col("_tp") / F.col("n_gt"), "precision": F.col("_tp") / F.col("_n"), "before": (F.col("_tp") - F.col("tp")) / F.col("n_gt")})
    later = Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    peaks = run.groupBy(*keys, "_part").agg(F.max("precision").alias("_peak")).withColumn("_later", F.max("_peak").over(later)).drop("_peak")
    back = inside.orderBy(F.col("score"), *[F.col(c).desc() for c in ties]).rowsBetween(Window.unboundedPreceding, 0)  # a running maximum, in linear time
    out = run.join(ordering.small(peaks), [*keys, "_part"]).withColumn("envelope", F.greatest(F.max("precision").over(back), "_later"))
    return out.drop("_part", "_n0", "_tp0", "_tp", "_n", "_later")


def average_precision(matches: DataFrame, truth: DataFrame, keys: list[str], points: int = 101, ties: tuple[str, ...] = ("det_id",)) -> DataFrame:
    """ap and ar for each key with truth (keys, n_gt): precision at the first recall >= r, mean over r = 0, .01, ..."""
    curve = precision_recall(matches.join(ordering.small(truth), keys), keys, ties)  # one row a key
    low = F.when(F.col("before") <= 0, 0).otherwise(F.floor(F.col("before") * (points - 1) + 1e-9) + 1)
    low = F.when((F.col("before") <= 0) & (F.col("recall") <= 0), points).otherwise(low)  # nothing is reached before the first hit
    high = F.least(F.lit(points - 1), F.floor(F.col("recall") * (points - 1) + 1e-9))
    gained = curve.withColumn("_hits", F.greatest(F.lit(0), high - low + 1)).groupBy(*keys).agg((F.sum(F.col("envelope") * F.col("_hits")) / points).alias("ap"), F.max("recall").alias("ar"))
    return truth.join(gained, keys, "left").select(*keys, "n_gt", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"))


def latency_report(df: DataFrame, value: str, order: str, warmup: int, keys: list[str]) -> DataFrame:
    """Mean, median, sample deviation, least, most and rate of the rows after the first `warmup` of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    kept = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > warmup)
    v = F.col(value)
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean_ms"), F.percentile(v, 0.5).alias("median_ms"), F.stddev_samp(v).alias("sd_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), (1000.0 / F.avg(v)).alias("per_second"))


def regression_gate(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (task, metric, value, tol) with the actual value and whether it is within tol; missing ones fail."""
    got = actual.select("task", "metric", F.col("value").alias("actual"))
    return expected.join(got, ["task", "metric"], "left").withColumn("passed", F.coalesce(F.abs(F.col("actual") - F.col("value")) <= F.col("tol"), F.lit(False)))


def long_metrics(df: DataFrame, task: str) -> DataFrame:
    """One row of metrics as (task, metric, value) rows in order of metric."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
    return df.select(F.explode(cells).alias("m")).select(F.lit(task).alias("task"), "m.metric", "m.value")


def merged_branches(parts: Mapping[tuple[str, int | None], DataFrame]) -> DataFrame:
    """One-row metric tables by (branch, layer) as rows (metric, branch, layer, value); metric ends in _branch and _layer."""
    rows = []
    for (branch, layer), df in parts.items():
        end = (f"_{branch}" if branch else "") + ("" if layer is None else f"_{layer}")
        named = long_metrics(df, "").withColumns({"metric": F.concat("metric", F.lit(end)), "branch": F.lit(branch), "layer": F.lit(layer).cast("int")})
        rows.append(named.select("metric", "branch", "layer", "value"))
    return reduce(DataFrame.unionByName, rows)


def weighted(metrics: DataFrame, weights: DataFrame) -> DataFrame:
    """Keeps the metrics that have a weight, multiplied by it."""
    return metrics.join(weights, "metric").withColumn("value", F.col("value") * F.col("weight")).drop("weight")


def focal_report(cls: DataFrame, target: Column, shards: int = 1) -> DataFrame:
    """Focal loss of (image_id, q, c, logit) against a 0/1 target: mean over queries, sum over classes, per object."""
    loss = act.focal_loss(F.col("logit"), target)
    objects = F.greatest(F.lit(1.0), F.sum(target) / shards)
    return cls.agg((F.sum(loss) / objects).alias("focal"), objects.alias("num_objects"))


def weighted_cross_entropy(cls: DataFrame, target_class: str, no_object: int, eos: float = 0.1) -> DataFrame:
    """Cross-entropy over classes with the no-object class weighted by eos; cls: image_id, q, c, logit, target_class."""
    peak = cls.groupBy("image_id", "q").agg(F.max("logit").alias("_m"))
    per = cls.join(peak, ["image_id", "q"]).groupBy("image_id", "q").agg(
        (F.max("_m") + F.ln(F.sum(F.exp(F.col("logit") - F.col("_m"))))).alias("lse"),
        F.max(F.when(F.col("c") == F.col(target_class), F.col("logit"))).alias("hit"), F.max(target_class).alias("t"),
    )
    weight = F.when(F.col("t") == no_object, eos).otherwise(1.0)
    return per.agg((F.sum(weight * (F.col("lse") - F.col("hit"))) / F.sum(weight)).alias("cross_entropy"))


def mask_losses(points: DataFrame, keys: list[str], logit: str, target: str) -> DataFrame:
    """Per matched mask: dice loss 1 - (2 pt + 1) / (p + t + 1) and mean sigmoid cross-entropy over its points."""
    p, t = act.sigmoid(F.col(logit)), F.col(target)
    dice = 1.0 - (2.0 * F.sum(p * t) + 1.0) / (F.sum(p) + F.sum(t) + 1.0)
    return points.groupBy(*keys).agg(dice.alias("dice"), F.avg(act.bce_with_logits(F.col(logit), t)).alias("bce"))
