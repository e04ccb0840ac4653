"""Sampling, noising and crops; randomness is a hash of keys and a seed, so a retried task draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering
from .annotations import global_numbers


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def lcg_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) by integer arithmetic alone, the same in any SQL engine; key below 2**40."""
    return (((key % 1000003) * 69069 + seed * 362437) % 1048573).cast("double") / 1048573.0


def stride_sample(df: DataFrame, fraction: float, order: str, group: str | None = None) -> DataFrame:
    """Every stride-th row in order, stride = 1 / fraction rounded half to even.

    Positions come from (group, order) by offsets of groups, or of range partitions; no task holds all rows."""
    if fraction >= 1:
        return df
    stride = round(1 / fraction)
    if group is None:
        return ordering.numbered(df, [order], "_at").filter(F.col("_at") % stride == 0).drop("_at")
    return global_numbers(df, group, order, "_at", 0).filter(F.col("_at") % stride == 0).drop("_at")


def topk_by_best_class(df: DataFrame, group: str, key: str, scores: str, k: int) -> DataFrame:
    """The k rows of each group whose best score is highest; ties to the smaller key."""
    best = df.withColumn("best", F.array_max(scores))
    w = Window.partitionBy(group).orderBy(F.col("best").desc(), key)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def uncertainty_sample(df: DataFrame, group: list[str], key: Column, n: int, oversample: float = 3.0, importance: float = 0.75, seed: int = 0, draw=None) -> DataFrame:
    """n points of each group: of n * oversample drawn candidates the n * importance least certain (|logit| smallest),
    the rest drawn from what is left. Groups with fewer points give all they have."""
    draw = draw or (lambda k, s: uniform(s, *[F.col(g) for g in group], k))
    w = Window.partitionBy(*group)
    drawn = df.withColumn("_u", draw(key, seed)).withColumn("_k", key)
    drawn = drawn.withColumn("_c", F.row_number().over(w.orderBy("_u", "_k")))
    cand = F.col("_c") <= int(n * oversample)
    ranked = drawn.withColumn("_r", F.row_number().over(w.orderBy(~cand, F.abs("logit"), "_k")))
    sure = cand & (F.col("_r") <= int(n * importance))
    rest = ranked.withColumn("_sure", sure).withColumn("_v", F.row_number().over(w.orderBy(F.col("_sure"), draw(key, seed + 1), "_k")))
    return rest.filter(F.col("_sure") | (F.col("_v") <= n - int(n * importance))).withColumn("important", F.col("_sure")).drop("_u", "_k", "_c", "_r", "_sure", "_v")


def noise_annotations(gt: DataFrame, number: int = 100, scale: float = 0.4, num_classes: int = 80, seed: int = 0, most: int | None = None, draw=None) -> DataFrame:
    """Replicas of (image_id, gt_id, label, cx, cy, w, h): number // (most objects of an image) of each object.

    A label changes with probability scale / 2; a box moves by up to half its size and grows by up to its size, times
    scale, clamped to [0, 1]. `slot` is position in image + replica * most. With `number` below the most objects the
    result is empty."""
    w = Window.partitionBy("image_id").orderBy("gt_id", "cx", "cy", "w", "h", "label")
    placed = gt.withColumn("_at", F.row_number().over(w) - 1)
    if most is None:
        most = placed.agg(F.max("_at")).first()[0]
        most = 0 if most is None else most + 1
    replicas = number // most if most else 0
    draw = draw or (lambda k, s: uniform(s, k))
    rows = placed.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(max(replicas, 1))))).withColumn("replica", F.col("replica") - 1)
    rows = rows if replicas else rows.limit(0)
    key = F.col("gt_id") * 131 + F.col("replica")
    u = [draw(key, seed + i) for i in range(6)]
    jitter = lambda i: (u[i] * 2 - 1) * scale
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return rows.select(
        "image_id", "gt_id", "replica", (F.col("_at") + F.col("replica") * most).cast("bigint").alias("slot"),
        F.when(u[4] < scale / 2, F.floor(u[5] * num_classes)).otherwise(F.col("label")).cast("bigint").alias("label"),
        clamp(F.col("cx") + jitter(0) * F.col("w") / 2).alias("cx"), clamp(F.col("cy") + jitter(1) * F.col("h") / 2).alias("cy"),
        clamp(F.col("w") + jitter(2) * F.col("w")).alias("w"), clamp(F.col("h") + jitter(3) * F.col("h")).alias("h"),
    )


def accepted_crop(px: DataFrame, crops: DataFrame, most: float = 1.0, ignore: int = 255, labelled: bool = False) -> DataFrame:
    """The first crop (image_id, attempt, cx0, cy0, cx1, cy1) of each image in which no category takes more than `most`
    of the labelled pixels; if none is fit, the last one. With `labelled` crops without a labelled pixel are no candidates."""
    inside = crops.join(px.filter(F.col("label") != ignore), "image_id").filter((F.col("x") >= F.col("cx0")) & (F.col("x") < F.col("cx1")) & (F.col("y") >= F.col("cy0")) & (F.col("y") < F.col("cy1")))
    share = inside.groupBy("image_id", "attempt", "label").agg(F.count("*").alias("n")).groupBy("image_id", "attempt").agg((F.max("n") / F.sum("n")).alias("share"), F.count("*").alias("labels"))
    judged = crops.join(share, ["image_id", "attempt"], "inner" if labelled else "left").withColumn("fit", F.coalesce((F.col("labels") > 1) & (F.col("share") < most), F.lit(False)))
    order = Window.partitionBy("image_id").orderBy(F.col("fit").desc(), F.when(F.col("fit"), F.col("attempt")).otherwise(-F.col("attempt")))
    return judged.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
