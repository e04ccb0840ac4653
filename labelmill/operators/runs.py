"""Masks as sorted runs, and set algebra on them by sweeps: overlap, union, erosion and boundary, never by pixels.

A mask of the packed form is one row with `runs`, a flat array start, end, start, end, ... of row-major positions
y * width + x, end exclusive, sorted and disjoint, no run longer than its row; `width` is the image's. Run tables have
one row a run: keys, y, x0, x1 (exclusive)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import boxes

Sweep = tuple[np.ndarray, np.ndarray]
#: From a column of masks in any form to the flat runs of all of them, and how many numbers each has; null has none.
Decode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


# --- sweeps over sorted intervals of many masks at once ---------------------------------------------------------------
def intersect(a: Sweep, b: Sweep) -> Sweep:
    """The common parts of two sets of sorted disjoint intervals (starts, ends)."""
    first = np.searchsorted(b[1], a[0], "right")
    n = np.maximum(0, np.searchsorted(b[0], a[1], "left") - first)
    i = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]
    return np.maximum(a[0][i], b[0][j]), np.minimum(a[1][i], b[1][j])


def without(a: Sweep, b: Sweep) -> Sweep:
    """Set a less its subset b: what begins where a does or b ends, and ends where b begins or a does."""
    start, end = np.sort(np.append(a[0], b[1])), np.sort(np.append(a[1], b[0]))
    some = start < end
    return start[some], end[some]


def covered_by(a: Sweep, b: Sweep) -> np.ndarray:
    """For each interval of b how much of it lies in a."""
    if not len(a[0]):
        return np.zeros(len(b[0]), np.int64)
    before = np.append(0, np.cumsum(a[1] - a[0]))

    def below(p: np.ndarray) -> np.ndarray:
        k = np.searchsorted(a[0], p, "right") - 1
        inside = np.minimum(p, a[1][k]) - a[0][k]
        return np.where(k < 0, 0, before[k] + inside)

    return below(b[1]) - below(b[0])


def _below(line: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of intervals i and j that lie `more` lines below, of intervals sorted by line, where each line between has some; none
    if lines are so full of intervals that their pairs are many."""
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])[: len(line)])
    own, n = line[first], np.diff(np.append(first, len(line)))
    to = np.minimum(np.arange(len(first)) + more, len(first) - 1)
    m = np.where(own[to] == own + more, n[to], 0)
    each = np.repeat(m, n)
    if each.sum() > 4 * len(line):
        return None
    i = np.repeat(np.arange(len(line)), each)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(np.repeat(first[to], n), each)


def eroded(runs: Sweep, stride: np.ndarray, line: np.ndarray, distance: int) -> Sweep:
    """Places whose square of 2 * distance + 1 is full: runs shortened on both sides, then rows intersected with their
    neighbours, twice as many at a time. stride: the row length of each run's mask; line: its row, a number for each mask and row
    in their order, and rows of masks far apart."""
    start, end = runs[0] + distance, runs[1] - distance
    some = start < end
    now, step, line = (start[some], end[some]), stride[some], line[some]
    have, want = 1, 2 * distance + 1
    while have < want and len(now[0]):
        # a row meets the one `more` below it: what both hold is held by all rows between, so none of these is missing
        more = min(have, want - have)
        met = _below(line, more)
        if met is None:  # shifted intervals keep their order within a mask, and masks lie far apart
            shifted = (now[0] - more * step, now[1] - more * step)
            first = np.searchsorted(shifted[1], now[0], "right")
            n = np.maximum(0, np.searchsorted(shifted[0], now[1], "left") - first)
            step, line, now = np.repeat(step, n), np.repeat(line, n), intersect(now, shifted)
        else:
            (i, j), far = met, more * step
            step, line, far = step[i], line[i], far[i]
            start, end = np.maximum(now[0][i], now[0][j] - far), np.minimum(now[1][i], now[1][j] - far)
            some = start < end
            now, step, line = (start[some], end[some]), step[some], line[some]
        have += more
    return now[0] + distance * step, now[1] + distance * step


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and how many each row has; null counts as empty."""
    n = np.diff(column.offsets.to_numpy())
    return column.values.to_numpy()[column.offsets[0].as_py() : column.offsets[-1].as_py()], n


def _apart(values: np.ndarray, n: np.ndarray, span: int) -> tuple[Sweep, np.ndarray]:
    """Intervals of all rows on one line, row k moved by k * span; and the row of each."""
    row = np.repeat(np.arange(len(n)), n // 2)
    return (values[0::2] + row * span, values[1::2] + row * span), row


def _packed(runs: Sweep, row: np.ndarray, rows: int, span: int) -> pa.Array:
    flat = np.stack([runs[0] - row * span, runs[1] - row * span], axis=1).ravel()
    ends = np.append(0, np.cumsum(2 * np.bincount(row, minlength=rows)))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


def inner(runs: Sweep, row: np.ndarray, span: int, width: np.ndarray, distance: np.ndarray) -> Sweep:
    """What erosion leaves of masks on one line, `span` apart, each by its own distance; width and distance: of each row."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    near, stride = distance[row], width[row]
    y = (runs[0] - row * span) // stride
    line = row * (int(y.max(initial=0)) + 2 * int(near.max(initial=0)) + 2) + y
    for d in np.unique(near):
        own = near == d
        one = eroded((runs[0][own], runs[1][own]), stride[own], line[own], int(d))
        starts.append(one[0])
        ends.append(one[1])
    return np.sort(np.concatenate(starts)), np.sort(np.concatenate(ends))


def _bands(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int, Sweep]:
    """Of masks (runs, width, _d): their flat runs, how many numbers each has, the span between masks, and the bands on one line."""
    values, n = lists(part.column("runs"))
    width, distance = part.column("width").to_numpy().astype(np.int64), part.column("_d").to_numpy()
    most = int(distance.max(initial=0))
    span = int(values.max(initial=0)) + (4 * most + 4) * int(width.max(initial=1)) + 1
    runs, row = _apart(values, n, span)
    return values, n, span, without(runs, inner(runs, row, span, width, distance))


def _boundaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `band` to (..., runs, width, _d)."""
    for batch in batches:
        for part in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
            _, _, span, band = _bands(part)
            yield pa.RecordBatch.from_arrays([*part.columns, _packed(band, band[0] // span, part.num_rows, span)], names=[*part.schema.names, "band"])


def _boundary_areas(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`area` and `band` (places) instead of (..., runs, width, _d)."""
    for batch in batches:
        for part in (batch.slice(a, 4096) for a in range(0, batch.num_rows, 4096)):
            values, n, span, band = _bands(part)
            row = np.repeat(np.arange(part.num_rows), n // 2)
            area = np.bincount(row, values[1::2] - values[0::2], part.num_rows).astype(np.int64)
            near = np.bincount(band[0] // span, band[1] - band[0], part.num_rows).astype(np.int64)
            kept = [k for k in part.schema.names if k not in ("runs", "width", "_d")]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), pa.array(area), pa.array(near)], names=[*kept, "area", "band"])


def _steps(runs: Column) -> Column:
    """A packed mask as steps from each place to the next: rows of a mask repeat, so a shuffle packs them to little."""
    return F.transform(runs, lambda v, i: v - F.coalesce(F.get(runs, i - 1), F.lit(0).cast("bigint")))


def _from_steps(steps: np.ndarray, n: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(steps))
    return total[1:] - np.repeat(total[np.cumsum(n) - n], n)


def _overlaps(batches: Iterable[pa.RecordBatch], sides: Sequence[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    """For each (left, right, out) of columns of steps how many places both hold; the lists are dropped."""
    gone = {c for a, b, _ in sides for c in (a, b)}
    for batch in batches:
        for part in (batch.slice(a, 8192) for a in range(0, batch.num_rows, 8192)):
            kept = [k for k in part.schema.names if k not in gone]
            found = []
            for left, right, _ in sides:
                (v, n), (w, m) = lists(part.column(left)), lists(part.column(right))
                v, w = _from_steps(v, n), _from_steps(w, m)
                span = max(int(v.max(initial=0)), int(w.max(initial=0))) + 1
                (a, _), (b, row) = _apart(v, n, span), _apart(w, m, span)
                found.append(pa.array(np.bincount(row, covered_by(a, b), part.num_rows).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *found], names=[*kept, *(s[2] for s in sides)])


def _measures(batches: Iterable[pa.RecordBatch], mask: str, decode: Decode) -> Iterator[pa.RecordBatch]:
    """Adds `area` and the box to (..., mask, width): null where the mask is, and no box where it is empty."""
    for batch in batches:
        for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
            values, n = decode(part.column(mask))
            start, end, n = values[0::2], values[1::2], n // 2
            row, some = np.repeat(np.arange(len(n)), n), np.flatnonzero(n)
            width = part.column("width").fill_null(1).to_numpy().astype(np.int64)
            first = (np.cumsum(n) - n)[some]
            line = width[row]
            sides = [np.minimum.reduceat(start % line, first), start[first] // width[some], np.maximum.reduceat((end - 1) % line + 1, first), (end[first + n[some] - 1] - 1) // width[some] + 1] if len(some) else [np.zeros(0)] * 4
            box = [np.zeros(len(n)) for _ in sides]
            for to, side in zip(box, sides):
                to[some] = side
            area = np.bincount(row, end - start, len(n)).astype(np.int64)
            none = part.column(mask).is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(area, mask=none), *(pa.array(b, mask=n == 0) for b in box)], names=[*part.schema.names, "area", *boxes.XYXY])


def _close(batches: Iterable[pa.RecordBatch], least: float, decode: Decode, boundary: bool) -> Iterator[pa.RecordBatch]:
    """Of pairs of masks (..., crowd, d_mask, g_mask; with `boundary` d_width, d_near, g_width, g_near) those whose value is `least`
    or a rounding below: places that both hold (`n`) and those of each (`d_n`, `g_n`), and the same of the bands."""
    gone = {f"{m}_{c}" for m in "dg" for c in ("mask", "width", "near")}
    for batch in batches:
        for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
            rows, sides = part.num_rows, [decode(part.column(f"{m}_mask")) for m in "dg"]
            column = lambda c: part.column(c).to_numpy().astype(np.int64)
            room = 0
            if boundary:
                wide, near = ([column(f"{m}_{c}") for m in "dg"] for c in ("width", "near"))
                room = (4 * int(np.max(near, initial=0)) + 4) * int(np.max(wide, initial=1))
            span = max(int(v.max(initial=0)) for v, _ in sides) + room + 1
            (d, of_d), (g, of_g) = (_apart(v, n, span) for v, n in sides)
            common = lambda a, b: np.bincount(b[0] // span, covered_by(a, b), rows).astype(np.int64)
            size = lambda a: np.bincount(a[0] // span, a[1] - a[0], rows).astype(np.int64)
            both, d_n, g_n = common(d, g), size(d), size(g)
            crowd = part.column("crowd").to_numpy(zero_copy_only=False)
            reach = lambda n, a, b: (n > 0) & (n >= (least - 1e-9) * np.where(crowd, a, a + b - n))
            kept, found = reach(both, d_n, g_n), [both, d_n, g_n]
            if boundary:  # bands only where the masks reach it
                d, of_d, g, of_g = ((x[0][at], x[1][at]) if isinstance(x, tuple) else x[at] for at, pair in ((kept[of_d], (d, of_d)), (kept[of_g], (g, of_g))) for x in pair)
                in_d, in_g = inner(d, of_d, span, wide[0], near[0]), inner(g, of_g, span, wide[1], near[1])
                bands = [both - common(d, in_g) - common(in_d, g) + common(in_d, in_g), d_n - size(in_d), g_n - size(in_g)]
                kept &= reach(*bands)
                found += bands
            at = np.flatnonzero(kept)
            names = [k for k in part.schema.names if k not in gone]
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(at)) for k in names), *(pa.array(c[at]) for c in found)], names=[*names, *_COUNTS[: len(found)]])


_COUNTS = ("n", "d_n", "g_n", "band_n", "d_band_n", "g_band_n")


def ddl(df: DataFrame, drop: Iterable[str] = (), more: str = "") -> str:
    gone = set(drop)
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in gone] + ([more] if more else []))


# --- masks of the packed form -----------------------------------------------------------------------------------------
def packed(runs: DataFrame, keys: Sequence[str], width: Column) -> DataFrame:
    """One mask for each key of a run table, with `width` (an expression of the keys)."""
    one = F.struct((F.col("y") * width + F.col("x0")).cast("bigint").alias("a"), (F.col("y") * width + F.col("x1")).cast("bigint").alias("b"))
    lists = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("runs"))
    return lists.select(*keys, F.flatten(F.transform("runs", lambda r: F.array(r["a"], r["b"]))).alias("runs"), width.cast("bigint").alias("width"))


def area(runs: Column) -> Column:
    """Places of a packed mask."""
    return F.aggregate(F.transform(runs, lambda v, i: F.when(i % 2 == 0, -v).otherwise(v)), F.lit(0).cast("bigint"), lambda a, v: a + v)


def with_boxes(masks: DataFrame) -> DataFrame:
    """Masks with their boxes x0..y1 (exclusive, double), from the runs; an empty mask has none."""
    w = F.col("width")
    first, last = F.filter("runs", lambda v, i: i % 2 == 0), F.filter("runs", lambda v, i: i % 2 == 1)
    box = (F.array_min(F.transform(first, lambda v: v % w)), F.floor(F.array_min(first) / w), F.array_max(F.transform(last, lambda v: (v - 1) % w + 1)), F.floor((F.array_max(last) - 1) / w) + 1)
    return masks.select("*", *[c.cast("double").alias(n) for n, c in zip(boxes.XYXY, box)])


def with_boundary(masks: DataFrame, distance: Column | int) -> DataFrame:
    """Masks with `band`, the packed places within `distance` (of each image, 1 at least) of the outside.

    Beyond the image counts as outside. Runs are shortened, rows intersected with their neighbours, and the rest is
    taken from the mask; a mask is bounded by its image, and masks are worked on some thousands at a time."""
    df = masks.withColumn("_d", (F.lit(distance) if isinstance(distance, int) else distance).cast("bigint")).withColumn("width", F.col("width").cast("bigint"))
    return df.mapInArrow(_boundaries, ddl(df, more="band array<bigint>")).drop("_d")


def boundary_areas(masks: DataFrame, distance: Column | int) -> DataFrame:
    """Places of each mask (`area`) and of its boundary (`band`) instead of its runs and width; only numbers come back."""
    df = masks.withColumn("_d", (F.lit(distance) if isinstance(distance, int) else distance).cast("bigint")).withColumn("width", F.col("width").cast("bigint"))
    return df.mapInArrow(_boundary_areas, ddl(df, ["runs", "width", "_d"], "area bigint, band bigint"))


def mask_pairs(gt: DataFrame, det: DataFrame, on: Sequence[str] = ("image_id", "category_id"), boundary: bool = False, grid: float | None = None) -> DataFrame:
    """(keys, det_id, score, gt_id, v, crowd) of masks that overlap; v is IoU, or for a crowd intersection over detection.

    gt: keys, gt_id, iscrowd, runs, x0..y1; det: keys, det_id, score, runs, x0..y1, of the same image widths. With
    `boundary` both also have `band`, and v is the smaller one of the masks' and the bands' value. Masks meet by their keys where
    their boxes overlap, so runs are shuffled once a side; with `grid` boxes meet by cells, and runs are joined by id."""
    on = list(on)
    parts = ("runs", "band") if boundary else ("runs",)

    def side(df: DataFrame, key: str, mark: str, more: str, *place: Column) -> DataFrame:
        return df.select(*on, key, more, *place, *[_steps(F.col(p)).alias(mark + p) for p in parts], *[area(F.col(p)).alias(f"{mark}{p}_n") for p in parts])

    if grid is None:
        box = lambda mark: [F.col(c).alias(mark + c) for c in boxes.XYXY]
        met = side(det, "det_id", "d_", "score", *box("a_")).join(side(gt, "gt_id", "g_", "iscrowd", *box("b_")), on)
        met = met.filter(G.intersection(G.columns("a_"), G.columns("b_")) > 0).drop(*[m + c for m in ("a_", "b_") for c in boxes.XYXY])
    else:
        met = boxes.overlapping_pairs(det.select(*on, "det_id", *boxes.XYXY), gt.select(*on, "gt_id", *boxes.XYXY), on, grid).select(*on, F.col("a_det_id").alias("det_id"), F.col("b_gt_id").alias("gt_id"))
        met = met.join(side(det, "det_id", "d_", "score"), [*on, "det_id"]).join(side(gt, "gt_id", "g_", "iscrowd"), [*on, "gt_id"])
    sides = [(f"g_{p}", f"d_{p}", f"{p}_n") for p in parts]
    counted = met.mapInArrow(lambda it: _overlaps(it, sides), ddl(met, [c for s in sides for c in s[:2]], ", ".join(f"{s[2]} bigint" for s in sides)))
    crowd = F.coalesce(F.col("iscrowd"), F.lit(0)) == 1
    value = [F.when(crowd, F.try_divide(f"{p}_n", f"d_{p}_n")).otherwise(F.try_divide(F.col(f"{p}_n"), F.col(f"d_{p}_n") + F.col(f"g_{p}_n") - F.col(f"{p}_n"))) for p in parts]
    v = F.least(*value) if boundary else value[0]
    return counted.filter("runs_n > 0").select(*on, "det_id", "score", "gt_id", F.round(v, 12).alias("v"), crowd.alias("crowd"))


def measured(masks: DataFrame, mask: str = "runs", decode: Decode = lists) -> DataFrame:
    """Masks of any form that `decode` knows, with `area` and their boxes x0..y1 (exclusive, double), as `area` and `with_boxes` give them of runs."""
    df = masks.withColumn("width", F.col("width").cast("bigint"))
    return df.mapInArrow(lambda it: _measures(it, mask, decode), ddl(df, more="area bigint, x0 double, y0 double, x1 double, y1 double"))


def close_pairs(gt: DataFrame, det: DataFrame, least: float, on: Sequence[str] = ("image_id", "category_id"), distance: Column | None = None, mask: str = "runs", decode: Decode = lists) -> DataFrame:
    """Pairs as from mask_pairs whose v is `least` (above 0) or more, with the truth's `area`; by bands too where a `distance` is given.

    gt: keys, gt_id, iscrowd, width, mask; det: keys, det_id, score, width, mask; both with `area` and boxes as from `measured`. Masks
    meet by their keys in the form they come in. Two masks share no more than their boxes do and than the smaller one has: of the pairs that
    may reach `least` by that the runs are decoded and counted, and bands exist only of those whose masks reach it."""
    on, boundary = list(on), distance is not None

    def side(df: DataFrame, mark: str, *own: Column | str) -> DataFrame:
        near = [] if not boundary else [F.col("width").cast("bigint").alias(f"{mark}_width"), distance.cast("bigint").alias(f"{mark}_near")]
        return df.select(*on, *own, F.col("area").alias(f"{mark}_area"), F.col(mask).alias(f"{mark}_mask"), *near, *[F.col(c).alias(f"{mark}_{c}") for c in boxes.XYXY])

    crowd = F.coalesce(F.col("iscrowd"), F.lit(0)) == 1
    met = side(det, "d", "det_id", "score").join(side(gt, "g", "gt_id", crowd.alias("crowd")), on)
    most = F.least(G.intersection(G.columns("d_"), G.columns("g_")), "d_area", "g_area")
    whole = F.when(F.col("crowd"), F.col("d_area")).otherwise(F.col("d_area") + F.col("g_area") - most)
    met = met.filter((most > 0) & (most >= F.lit(least - 1e-9) * whole)).drop("d_area", *[f"{m}_{c}" for m in "dg" for c in boxes.XYXY])
    parts = ("", "band_") if boundary else ("",)
    counts = _COUNTS[: 3 * len(parts)]
    counted = met.mapInArrow(lambda it: _close(it, least, decode, boundary), ddl(met, [f"{m}_{c}" for m in "dg" for c in ("mask", "width", "near")], ", ".join(f"{c} bigint" for c in counts)))
    value = [F.when(F.col("crowd"), F.try_divide(f"{p}n", f"d_{p}n")).otherwise(F.try_divide(F.col(f"{p}n"), F.col(f"d_{p}n") + F.col(f"g_{p}n") - F.col(f"{p}n"))) for p in parts]
    v = F.least(*value) if boundary else value[0]
    return counted.select(*on, "det_id", "score", "gt_id", F.col("g_area").alias("area"), F.round(v, 12).alias("v"), "crowd").filter(F.col("v") >= float(least))


# --- run tables -------------------------------------------------------------------------------------------------------
def union_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping or touching runs of a row as one: an island begins where no run before reaches."""
    row = Window.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    begins = runs.withColumn("_new", (reach.isNull() | (F.col("x0") > reach)).cast("int"))
    island = F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0))
    return begins.withColumn("_i", island).groupBy(*keys, "y", "_i").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_i")


def _decoded(batches: Iterable[pa.RecordBatch], keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The on-runs of each row's counts as (kept columns, start, end) of column-major positions."""
    for batch in batches:
        values, n = lists(batch.column("_counts"))
        ends = np.cumsum(values)
        row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        base = np.append(0, ends)[first]
        place = np.arange(len(values)) - first[row]
        on = np.flatnonzero((place % 2 == 1) & (values > 0))
        of = pa.array(row[on])
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(of) for k in keep), pa.array(ends[on] - values[on] - base[row[on]]), pa.array(ends[on] - base[row[on]])], names=[*keep, "_a", "_b"])


def rle_runs(df: DataFrame, rle: str = "rle") -> DataFrame:
    """The on-runs of column-major run lengths: the other columns, `_h` (height) and positions _a to _b (exclusive).

    Sums run over the counts in batches, so a mask of many runs costs no more than its length. A null mask has none."""
    keep = [c for c in df.columns if c != rle]
    rows = df.filter(F.col(rle).isNotNull()).select(*keep, F.col(f"{rle}.size")[0].cast("bigint").alias("_h"), F.col(f"{rle}.counts").cast("array<bigint>").alias("_counts"))
    return rows.mapInArrow(lambda it: _decoded(it, [*keep, "_h"]), ddl(rows, ["_counts"], "_a bigint, _b bigint"))

