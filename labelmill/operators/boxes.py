"""Pairwise box operators: joins within an image, with a grid for dense images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

XYXY = ("x0", "y0", "x1", "y1")


def _sides(a: DataFrame, b: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    rename = lambda df, mark: df.select(*on, *[F.col(c).alias(mark + c) for c in df.columns if c not in on])
    return rename(a, "a_"), rename(b, "b_")


def pairs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Every pair of rows with equal keys; other columns get the prefix a_ or b_. One equi-join, skew split by AQE."""
    left, right = _sides(a, b, on)
    return left.join(right, on)


def _cells(df: DataFrame, mark: str, side: Column) -> DataFrame:
    """df once for each cell of width `side` that its box touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(mark + lo) / side), F.floor(F.col(mark + hi) / side))
    return df.withColumn("_gx", F.explode(span("x0", "x1"))).withColumn("_gy", F.explode(span("y0", "y1")))


def _level(mark: str, grid: float) -> Column:
    """The level whose cells, grid * 2 ** level wide, are at least as wide and high as the box."""
    longest = F.greatest(F.col(mark + "x1") - F.col(mark + "x0"), F.col(mark + "y1") - F.col(mark + "y0"))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest, F.lit(grid)) / grid))).cast("int")


def _pairs_by_cell(left: DataFrame, right: DataFrame, on: list[str], grid: float) -> DataFrame:
    """Overlapping pairs, met once each: in the cell that holds their intersection's top left corner.

    Cells come in levels, each twice as wide as the one below; a box lies in at most four cells of its own level. A pair
    meets at the level of its larger box, so a box is also entered at the coarser levels that the other side has under
    the same keys: the rows for a box are bounded by four a level, whatever its size."""
    left, right = left.withColumn("_own", _level("a_", grid)), right.withColumn("_own", _level("b_", grid))
    levels = lambda df: df.groupBy(*on).agg(F.collect_set("_own").alias("_levels"))  # noqa: E731  some dozens at most
    width = F.lit(float(grid)) * F.pow(F.lit(2.0), F.col("_level"))

    def entered(df: DataFrame, mark: str) -> DataFrame:
        return _cells(df.drop("_own"), mark, width)

    def coarser(df: DataFrame, other: DataFrame) -> DataFrame:
        met = df.join(levels(other), on)
        return met.withColumn("_level", F.explode(F.filter("_levels", lambda x: x > F.col("_own")))).drop("_levels")

    place = [*on, "_level", "_gx", "_gy"]
    own_a, own_b = (entered(df.withColumn("_level", F.col("_own")), m) for df, m in ((left, "a_"), (right, "b_")))
    met = own_a.join(own_b.unionByName(entered(coarser(right, left), "b_")), place).unionByName(entered(coarser(left, right), "a_").join(own_b, place))
    home = (F.floor(F.greatest("a_x0", "b_x0") / width) == F.col("_gx")) & (F.floor(F.greatest("a_y0", "b_y0") / width) == F.col("_gy"))
    return met.filter(home & (G.intersection(G.columns("a_"), G.columns("b_")) > 0)).drop("_level", "_gx", "_gy")


def overlapping_pairs(a: DataFrame, b: DataFrame, on: list[str], grid: float, dense: int = 4096) -> DataFrame:
    """Pairs whose boxes overlap. Keys with more than `dense` pairs of rows, as crowded images have them, meet by grid cells
    (`grid` is the smallest one's width); the others in a plain join, whose rows are then bounded by that."""
    left, right = _sides(a, b, on)
    n = [df.groupBy(*on).agg(F.count("*").alias(c)) for df, c in ((left, "_n"), (right, "_m"))]
    crowded = n[0].join(n[1], on).filter(F.col("_n") * F.col("_m") > dense).select(*on)
    few = left.join(crowded, on, "left_anti").join(right, on)
    many = _pairs_by_cell(left.join(crowded, on, "left_semi"), right.join(crowded, on, "left_semi"), on, grid)
    return few.filter(G.intersection(G.columns("a_"), G.columns("b_")) > 0).unionByName(many)


def pairwise_iou(a: DataFrame, b: DataFrame, on: list[str], eps: float = 1e-6, grid: float | None = None) -> DataFrame:
    """Pairs with `iou` and `union_area`; with `grid` only overlapping pairs, found by cell."""
    met = pairs(a, b, on) if grid is None else overlapping_pairs(a, b, on, grid)
    x, y = G.columns("a_"), G.columns("b_")
    return met.withColumn("iou", G.iou(x, y, eps)).withColumn("union_area", G.union(x, y))


def pairwise_giou(a: DataFrame, b: DataFrame, on: list[str], eps: float = 1e-6) -> DataFrame:
    return pairs(a, b, on).withColumn("giou", G.giou(G.columns("a_"), G.columns("b_"), eps))


def matched_iou(matched: DataFrame) -> DataFrame:
    """IoU and GIoU of rows that already hold both boxes (a_*, b_*), without epsilon: null where no area is."""
    x, y = G.columns("a_"), G.columns("b_")
    return matched.withColumn("iou", G.iou(x, y, 0.0)).withColumn("giou", G.giou(x, y, 0.0))


def pairwise_l1(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return pairs(a, b, on).withColumn("l1", G.l1(G.columns("a_"), G.columns("b_")))


def invalid_boxes(df: DataFrame, names=XYXY) -> DataFrame:
    """Rows whose box has a negative side or a missing or non-number coordinate."""
    x0, y0, x1, y1 = (F.col(n) for n in names)
    odd: Column = (x1 < x0) | (y1 < y0)
    for c in (x0, y0, x1, y1):
        odd = odd | c.isNull() | F.isnan(c.cast("double"))
    return df.filter(odd)
