"""Label rasters as pixels (image_id, y, x, label) or runs (image_id, y, x0, x1, label)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runs as sweeps


def segment_areas(px: DataFrame, label: str = "label", keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return px.groupBy(*keys, label).agg(F.count("*").alias("area"))


def run_areas(runs: DataFrame, label: str = "label") -> DataFrame:
    return runs.groupBy("image_id", label).agg(F.sum(F.col("x1") - F.col("x0")).alias("area"))


def mask_boxes(px: DataFrame, keys: list[str], convention: str = "inclusive") -> DataFrame:
    """Bounding box of each group: inclusive and exclusive give x0,y0,x1,y1; xywh gives x,y,w,h."""
    more = {"inclusive": 0, "xywh": 1, "exclusive": 1}[convention]
    box = px.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + more).alias("x1"), (F.max("y") + more).alias("y1"))
    if convention != "xywh":
        return box
    return box.select(*keys, F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))


def mask_boxes_or_default(masks: DataFrame, px: DataFrame, keys: list[str]) -> DataFrame:
    """Inclusive boxes of all masks listed; a mask without pixels has the box (1e8, 1e8, 0, 0)."""
    box = masks.select(*keys).distinct().join(mask_boxes(px, keys), keys, "left")
    return box.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(d)).alias(c) for c, d in (("x0", 1e8), ("y0", 1e8), ("x1", 0.0), ("y1", 0.0))])


def distinct_labels(px: DataFrame, label: str = "label") -> DataFrame:
    return px.select("image_id", label).distinct()


def without_label(px: DataFrame, label: str, ignore: int) -> DataFrame:
    return px.filter(F.col(label) != ignore)


def covered(px: DataFrame, painted: DataFrame, label: str, default: int) -> DataFrame:
    """All pixels of px with the painted label, or the default where nothing is painted."""
    return px.join(painted, ["image_id", "y", "x"], "left").withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def pixels_to_runs(px: DataFrame, label: str = "label") -> DataFrame:
    """Row-major runs of equal label: islands of x - row_number within (image, y, label)."""
    w = Window.partitionBy("image_id", "y", label).orderBy("x")
    return (
        px.withColumn("_island", F.col("x") - F.row_number().over(w))
        .groupBy("image_id", "y", label, "_island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_island")
    )


def runs_to_pixels(runs: DataFrame) -> DataFrame:
    return runs.withColumn("x", F.explode(F.sequence("x0", F.col("x1") - 1))).drop("x0", "x1")


def run_overlap(a: DataFrame, b: DataFrame, a_label: str, b_label: str) -> DataFrame:
    """Overlapping runs of two rasters: an interval join on (image, row), with the shared length as weight n."""
    left = a.select("image_id", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), a_label)
    right = b.select("image_id", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), b_label)
    met = left.join(right, ["image_id", "y"]).filter((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    return met.select("image_id", a_label, b_label, (F.least("a1", "b1") - F.greatest("a0", "b0")).alias("n"))


def rle_encode(px: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """Column-major run lengths of the mask pixels of each group, alternately off and on, off first.

    Only mask pixels move, sorted once: a run goes from a pixel that none precedes to one that none follows."""
    w = Window.partitionBy(*keys).orderBy("_p")
    near = px.select(*keys, (F.col("x") * height + F.col("y")).cast("bigint").alias("_p")).withColumns({"_l": F.lag("_p").over(w), "_n": F.lead("_p").over(w)})
    begin = F.when(F.coalesce(F.col("_l") < F.col("_p") - 1, F.lit(True)), F.col("_p"))
    end = F.when(F.coalesce(F.col("_n") > F.col("_p") + 1, F.lit(True)), F.col("_p") + 1)
    ends = near.select(*keys, begin.alias("_a"), end.alias("_b")).filter("_a is not null or _b is not null")
    runs = ends.groupBy(*keys).agg(F.sort_array(F.collect_list("_a")).alias("_a"), F.sort_array(F.collect_list("_b")).alias("_b"), F.max("_b").alias("_end"))
    off = lambda a, i: a - F.when(i > 0, F.get("_b", i - 1)).otherwise(0)
    counts = F.flatten(F.transform("_a", lambda a, i: F.array(off(a, i), F.get("_b", i) - a)))
    rest = F.lit(height * width) - F.col("_end")
    counts = F.when(rest > 0, F.concat(counts, F.array(rest))).otherwise(counts)
    return runs.select(*keys, F.struct(F.array(F.lit(height), F.lit(width)).alias("size"), F.transform(counts, lambda c: c.cast("bigint")).alias("counts")).alias("rle"))


def rle_area(rle: Column) -> Column:
    """Pixels of a mask: the odd entries of its counts."""
    return F.aggregate(F.filter(rle["counts"], lambda c, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, c: a + c)


def rle_decode(df: DataFrame, rle: str = "rle") -> DataFrame:
    """The mask pixels (y, x) of each row's run lengths; the other columns stay."""
    keep = [c for c in df.columns if c != rle]
    places = sweeps.rle_runs(df, rle).select(*keep, "_h", F.explode(F.sequence("_a", F.col("_b") - 1)).alias("_p"))
    return places.select(*keep, F.pmod("_p", "_h").alias("y"), F.floor(F.col("_p") / F.col("_h")).alias("x"))


def union_masks(px: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of a mask as one: each pixel once."""
    return px.select(*keys, "y", "x").distinct()


def boundary_distance(height: Column, width: Column, ratio: float = 0.02) -> Column:
    """Pixels of a boundary band: a share of the image's diagonal, at least 1."""
    return F.greatest(F.lit(1), F.rint(ratio * F.sqrt(height * height + width * width)).cast("int"))


def boundary_band(px: DataFrame, keys: list[str], distance: int | Column) -> DataFrame:
    """Mask pixels within `distance` of the outside: those whose square of 2 * distance + 1 is not full of mask pixels.

    The distance may differ by image. A square is full if along its column each pixel has the distance free on both
    sides in its row; islands of consecutive pixels give the room in rows, then in columns. Beyond the raster's edge
    counts as outside."""
    df = px.withColumn("_d", F.lit(distance) if isinstance(distance, int) else distance)

    def room(df: DataFrame, line: list[str], at: str) -> DataFrame:
        island = F.col(at) - F.row_number().over(Window.partitionBy(*line).orderBy(at))
        w = Window.partitionBy(*line, "_i")
        return df.withColumn("_i", island).withColumn("_room", F.least(F.col(at) - F.min(at).over(w), F.max(at).over(w) - F.col(at)))

    rows = room(df, [*keys, "y"], "x").withColumn("_ok", F.col("_room") >= F.col("_d"))
    cols = room(rows, [*keys, "x", "_ok"], "y")
    return cols.filter(~F.col("_ok") | (F.col("_room") < F.col("_d"))).drop("_d", "_i", "_room", "_ok")


def _whole_images(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by image, in whole images; `_of` is how many rows an image has."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        image, of = batch.column("image_id").to_numpy(), batch.column("_of").to_numpy()
        begin = int(np.searchsorted(image, image[-1]))  # of the last image, which may go on in the next batch
        begun = bool(held) and held[-1].column("image_id")[-1].as_py() == image[0]
        if begin or not begun:
            if begin:
                held.append(batch.slice(0, begin))
            if held:
                yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(begin))
        if sum(b.num_rows for b in held) == of[-1]:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _band_overlaps(batches: Iterable[pa.RecordBatch], labels: Sequence[str], distance: int, ignore: int) -> Iterator[pa.RecordBatch]:
    """(image_id, label, places of the band in each raster, n) of sorted pixels (image_id, y, x, labels, _of): masks of whole images
    lie one after another as runs on one line."""
    for table in _whole_images(batches):
        image, y, x = (table.column(c).to_numpy() for c in ("image_id", "y", "x"))
        of = np.cumsum(np.append(True, image[1:] != image[:-1])) - 1
        y, x = y - y.min(), x - x.min()
        width = int(x.max()) + 1
        span = (int(y.max()) + 1) * width + (4 * distance + 4) * width + 1
        sides = [table.column(c).to_numpy() for c in labels]
        known, code = np.unique(np.concatenate(sides), return_inverse=True)
        own = of * len(known) + code.reshape(2, -1)
        some = [s != ignore for s in sides]
        masks = np.unique(np.concatenate([o[k] for o, k in zip(own, some)]))
        rows, bands = len(masks), []
        for o, k in zip(own, some):
            place = np.unique(np.searchsorted(masks, o[k]) * span + y[k] * width + x[k])  # a place counts once
            new = np.append(True, (np.diff(place) != 1) | (place[1:] % span % width == 0))[: len(place)]
            run = place[new], place[np.append(new[1:], True)[: len(place)]] + 1
            bands.append(sweeps.without(run, sweeps.inner(run, run[0] // span, span, np.full(rows, width), np.full(rows, distance))))
        size = [np.bincount(a // span, b - a, rows).astype(np.int64) for a, b in bands]
        n = np.bincount(bands[1][0] // span, sweeps.covered_by(*bands), rows).astype(np.int64)
        image = image[np.searchsorted(of, masks // len(known))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (image, known[masks % len(known)], *size, n))], names=["image_id", "label", *(f"{c}_n" for c in labels), "n"])


def band_overlaps(px: DataFrame, distance: int, labels: Sequence[str] = ("gt", "pred"), ignore: int = 255) -> DataFrame:
    """(image_id, label, <labels>_n, n): for each label of an image the places of its boundary band, as of `boundary_band`, in each of two
    rasters, and those in both. px: image_id, y, x and both labels; null labels are ignored.

    Pixels of an image come together, without a shuffle where they are dealt by image already; runs, erosion and overlaps exist
    only in batches of whole images, and no pixel is joined."""
    px = px.select(*[F.col(c).cast("bigint").alias(c) for c in ("image_id", "y", "x")], *[F.coalesce(F.col(c).cast("bigint"), F.lit(ignore)).alias(c) for c in labels])
    px = px.filter("image_id is not null and y is not null and x is not null").withColumn("_of", F.count("*").over(Window.partitionBy("image_id")))
    sizes = ", ".join(f"{c}_n bigint" for c in labels)
    return px.mapInArrow(lambda it: _band_overlaps(it, labels, distance, ignore), f"image_id bigint, label bigint, {sizes}, n bigint")


def _filled(batches: Iterable[pa.RecordBatch], keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Runs of (keys, _flat, _n): all coordinates of a row's parts and how many each part has; rows some thousands at a time."""
    for batch in batches:
        for part in (batch.slice(a, 2048) for a in range(0, batch.num_rows, 2048)):
            (flat, _), (n, parts) = sweeps.lists(part.column("_flat")), sweeps.lists(part.column("_n"))
            first = np.cumsum(n) - n  # of a part, in coordinates
            corners = n // 2
            of = np.repeat(np.arange(len(n)), corners)
            i = np.arange(len(of)) - np.repeat(np.cumsum(corners) - corners, corners)
            a, b = first[of] + 2 * i, first[of] + 2 * ((i + 1) % corners[of])
            ax, ay, bx, by = flat[a], flat[a + 1], flat[b], flat[b + 1]
            row = np.repeat(np.arange(len(parts)), parts)[of]
            some = np.isfinite(ax + ay + bx + by) & (ay != by)
            ax, ay, bx, by, row = (v[some] for v in (ax, ay, bx, by, row))
            low = np.ceil(np.minimum(ay, by) - 0.5).astype(np.int64)
            high = np.maximum(low, np.ceil(np.maximum(ay, by) - 0.5).astype(np.int64))
            edge = np.repeat(np.arange(len(low)), high - low)
            y = np.arange(len(edge)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[edge]
            c = ax[edge] + (y + 0.5 - ay[edge]) * (bx[edge] - ax[edge]) / (by[edge] - ay[edge])
            order = np.lexsort((c, y, row[edge]))
            c, y, row = c[order], y[order], row[edge][order]
            new = np.append(True, (np.diff(row) != 0) | (np.diff(y) != 0))[: len(row)]
            place = np.arange(len(row)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            on = np.flatnonzero((place[:-1] % 2 == 0) & ~new[1:])  # every other crossing, with the next one of its row
            x0, x1 = np.ceil(c[on] - 0.5).astype(np.int64), np.ceil(c[on + 1] - 0.5).astype(np.int64)
            on, x0, x1 = on[x0 < x1], x0[x0 < x1], x1[x0 < x1]
            yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(row[on])) for k in keep), pa.array(y[on]), pa.array(x0), pa.array(x1)], names=[*keep, "y", "x0", "x1"])


def rasterize_polygons(polygons: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """Runs covered by flat x0,y0,x1,y1,... polygons: even-odd crossings of each pixel row's centre line.

    Crossings of a row are sorted and paired; a pixel belongs to a run if its centre does. Not the contour rule of
    up-sampling libraries, from which it can differ on the border. Polygons of equal keys are brought together before they are
    filled, so no crossing is shuffled; runs of a mask leave one task, one after another."""
    flat = F.transform(points, lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    even = F.slice(flat, 1, (F.size(points) / 2).cast("int") * 2)
    parts = polygons.filter(F.size(points) >= 6).select(*keys, even.alias("_p")).groupBy(*keys).agg(F.collect_list("_p").alias("_p"))
    rows = parts.select(*keys, F.flatten("_p").alias("_flat"), F.transform("_p", lambda p: F.size(p).cast("bigint")).alias("_n"))
    return rows.mapInArrow(lambda it: _filled(it, keys), sweeps.ddl(rows, ["_flat", "_n"], "y bigint, x0 bigint, x1 bigint"))
