"""Annotations: filters, category maps, and conversions between semantic, instance and panoptic forms."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering, rasters

# --- filters -----------------------------------------------------------------------------------------------------


def not_crowd(df: DataFrame, column: str = "iscrowd") -> DataFrame:
    """Rows whose crowd flag is 0 or missing."""
    return df.filter(F.coalesce(F.col(column), F.lit(0)) == 0)


def visible(df: DataFrame, least: float = 0.0, column: str = "visibility_fraction") -> DataFrame:
    """Rows at least so visible; a missing fraction counts as 1."""
    return df.filter(F.coalesce(F.col(column), F.lit(1.0)) >= least)


def keep_objects(ann: DataFrame, min_visibility: float = 0.0, drop_crowd: bool = True) -> DataFrame:
    ann = visible(ann, min_visibility)
    return not_crowd(ann) if drop_crowd else ann


def without_columns(ann: DataFrame, *names: str) -> DataFrame:
    return ann.drop(*names)


def drop_empty(ann: DataFrame, eps: float = 1e-5, area: Column | None = None) -> DataFrame:
    """Instances whose box has width and height above eps, and, if given, a mask area above 0."""
    kept = ann.filter((F.col("x1") - F.col("x0") > eps) & (F.col("y1") - F.col("y0") > eps))
    return kept if area is None else kept.filter(area > 0)


def drop_empty_images(images: DataFrame, ann: DataFrame) -> DataFrame:
    """Images with at least one annotation that is no crowd."""
    return images.join(not_crowd(ann), "image_id", "left_semi")


def score_filter(det: DataFrame, threshold: float = 0.5) -> DataFrame:
    return det.filter(F.col("score") > threshold)


def kept_counts(det: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    return det.groupBy(*keys).agg(F.count("*").alias("raw"), F.count_if(F.col("score") > threshold).alias("kept"))


# --- checks: each returns the rows that break a rule -------------------------------------------------------------


def several_categories(px: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Instances that do not have exactly one category."""
    return px.groupBy(*keys).agg(F.count_distinct(category).alias("n_categories")).filter("n_categories <> 1")


def unknown_ids(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    return df.join(known.select(column).distinct(), column, "left_anti")


def size_mismatches(images: DataFrame, inventory: DataFrame, on: str = "image_id") -> DataFrame:
    """Images whose recorded size differs from that found in the inventory."""
    found = inventory.select(on, F.col("height").alias("found_height"), F.col("width").alias("found_width"))
    return images.join(found, on).filter((F.col("height") != F.col("found_height")) | (F.col("width") != F.col("found_width")))


def id_differences(px: DataFrame, segments: DataFrame, keys: tuple[str, ...] = ("image_id", "seg_id")) -> DataFrame:
    """Segment ids that only the raster or only the document has, with `side`. Both sides meet in one grouping; ids with a
    null are equal to none, so each side keeps its own."""
    both = px.select(*keys, F.lit("raster").alias("side")).unionByName(segments.select(*keys, F.lit("document").alias("side")))
    alone = F.when(reduce(Column.__or__, [F.col(k).isNull() for k in keys]), F.col("side"))
    found = both.groupBy(*keys, alone.alias("_alone")).agg(F.min("side").alias("side"), F.max("side").alias("_other"))
    return found.filter(F.col("side") == F.col("_other")).select(*keys, "side")


def dataset_checks(tables: Mapping[str, DataFrame], categories: DataFrame, most: int = 254) -> DataFrame:
    """(rule, value, passed): every table has rows, and the categories fit one byte beside void."""
    counts = [df.agg(F.count("*").alias("value")).select(F.lit(f"{name} is not empty").alias("rule"), "value", (F.col("value") > 0).alias("passed")) for name, df in tables.items()]
    counts.append(categories.agg(F.count("*").alias("value")).select(F.lit(f"at most {most} categories").alias("rule"), "value", (F.col("value") <= most).alias("passed")))
    return reduce(DataFrame.unionByName, counts)


# --- category maps -----------------------------------------------------------------------------------------------


def contiguous_ids(categories: DataFrame, things_only: bool = False) -> DataFrame:
    """(id, contiguous_id, isthing) by position; things_only numbers the things alone. A dimension table."""
    cats = categories.filter("isthing = 1") if things_only else categories
    return cats.select("id", (F.row_number().over(Window.orderBy("pos")) - 1).cast("bigint").alias("contiguous_id"), "isthing")


def to_contiguous(df: DataFrame, categories: DataFrame, column: str = "category_id") -> DataFrame:
    """Adds contiguous_id and isthing: the thing map first, then the map of all; null in both if unknown."""
    thing = contiguous_ids(categories, True).select(F.col("id").alias(column), F.col("contiguous_id").alias("_t"))
    every = contiguous_ids(categories).select(F.col("id").alias(column), F.col("contiguous_id").alias("_s"))
    out = df.join(thing, column, "left").join(every, column, "left")
    return out.withColumn("isthing", F.when(F.coalesce("_t", "_s").isNotNull(), F.col("_t").isNotNull())).withColumn("contiguous_id", F.coalesce("_t", "_s")).drop("_t", "_s")


def to_dataset_id(df: DataFrame, categories: DataFrame, column: str = "contiguous_id", things_only: bool = False) -> DataFrame:
    """Adds category_id for each contiguous id; of several dataset ids the largest. Unknown ids leave the result."""
    back = contiguous_ids(categories, things_only).groupBy("contiguous_id").agg(F.max("id").alias("category_id"))
    return df.join(back.withColumnRenamed("contiguous_id", column), column)


def read_id_map_lines(lines: DataFrame, key_shift: int = 0, value_shift: int = -1) -> DataFrame:
    """(ins_id, sem_id) of numbered lines (line_no, value) `ins sem ...`: the later line wins, a header is skipped."""
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.col("line_no") > 0).select("line_no", F.try_element_at(part, F.lit(1)).try_cast("bigint").alias("k"), F.try_element_at(part, F.lit(2)).try_cast("bigint").alias("v")).filter("k is not null and v is not null")
    return rows.groupBy((F.col("k") + key_shift).alias("ins_id")).agg((F.max_by("v", "line_no") + value_shift).alias("sem_id"))


def mark_things(categories: DataFrame, id_map: DataFrame, column: str = "id") -> DataFrame:
    """isthing = 1 for categories that are a value of the id map."""
    values = id_map.select(F.col("sem_id").alias(column), F.lit(1).alias("_m")).distinct()
    return categories.drop("isthing").join(values, column, "left").withColumn("isthing", F.coalesce("_m", F.lit(0))).drop("_m")


def evaluated(categories: DataFrame) -> DataFrame:
    return categories.filter("evaluate")


def things(df: DataFrame, categories: DataFrame, column: str = "category_id", pos: str = "id") -> DataFrame:
    return df.join(categories.filter("isthing = 1").select(F.col(pos).alias(column)), column, "left_semi")


# --- joins and conversions ---------------------------------------------------------------------------------------


def paint_segments(px: DataFrame, segments: DataFrame, value: str, default: int = 255) -> DataFrame:
    """The value of each pixel's segment, of several the last by `seq`; default where no segment is."""
    last = segments.groupBy("image_id", "seg_id").agg(F.max_by(value, "seq").alias("_v"))
    return px.join(last, ["image_id", "seg_id"], "left").withColumn("label", F.coalesce("_v", F.lit(default))).drop("_v")


def class_objects(px: DataFrame, ignore: int, label: str = "label") -> DataFrame:
    """One object per label and image: area and exclusive box."""
    kept = rasters.without_label(px, label, ignore)
    return rasters.segment_areas(kept, label).join(rasters.mask_boxes(kept, ["image_id", label], "exclusive"), ["image_id", label])


def segment_objects(px: DataFrame, segments: DataFrame) -> DataFrame:
    """Area, exclusive box and category of every segment that is no crowd."""
    own = px.join(not_crowd(segments).select("image_id", "seg_id", "category_id"), ["image_id", "seg_id"])
    keys = ["image_id", "seg_id", "category_id"]
    return own.groupBy(*keys).agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def global_numbers(df: DataFrame, group: str, order: str, out: str, first: int = 1) -> DataFrame:
    """Numbers rows by (group, order) without one global sort: row numbers inside a group, plus the group's offset.

    Offsets are prefix sums in two levels: within range partitions of one row a group, and over the partitions."""
    per = ordering.ranged(df.groupBy(group).agg(F.count("*").alias("_n")), group)
    parts = ordering.before_parts(per.groupBy("_part").agg(F.sum("_n").alias("_all")), [], {"_start": "_all"})
    inside = F.sum("_n").over(Window.partitionBy("_part").orderBy(group)) - F.col("_n")
    offsets = per.withColumn("_in", inside).join(F.broadcast(parts), "_part").select(group, (F.col("_start") + F.col("_in")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_own", own).join(offsets, group).withColumn(out, F.col("_before") + F.col("_own") - 1 + first).drop("_own", "_before")


def extract_instances(px: DataFrame, id_map: DataFrame) -> DataFrame:
    """Annotations of (image_id, y, x, inst_cat_raw, inst_id): void id 0 left out, xywh box, area, global id from 1."""
    kept = px.filter("inst_id <> 0")
    keys = ["image_id", "inst_id"]
    box = rasters.mask_boxes(kept, keys, "xywh")
    area = kept.groupBy(*keys).agg(F.count("*").alias("area"), F.min("inst_cat_raw").alias("ins_id"))
    ann = area.join(box, keys).join(id_map, "ins_id").select(*keys, F.col("sem_id").alias("category_id"), "area", "x", "y", "w", "h", F.lit(0).alias("iscrowd"))
    return global_numbers(ann, "image_id", "inst_id", "id")


def semantic_from_panoptic(px: DataFrame, segments: DataFrame, categories: DataFrame, default: int = 255) -> DataFrame:
    """Each pixel's category as its position in the list of categories."""
    cats = contiguous_ids(categories).select(F.col("id").alias("category_id"), "contiguous_id")
    return paint_segments(px, segments.join(cats, "category_id"), "contiguous_id", default)


def panoptic_from_parts(px: DataFrame, categories: DataFrame, id_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlay of (image_id, y, x, sem, inst_id, inst_cat): instances over stuff.

    Returns pixels (image_id, y, x, seg_id) and segments. Area and box of stuff are those before instances cover it,
    as in the data this follows. Segment ids run from 1 in each image, stuff first."""
    cats = categories.select(F.col("id").alias("category_id"), "isthing")
    stuff = px.filter("sem <> 255").withColumnRenamed("sem", "category_id").join(cats.filter("isthing = 0").drop("isthing"), "category_id")
    inst = px.filter("inst_id <> 0").join(id_map, F.col("inst_cat") == F.col("ins_id")).withColumnRenamed("sem_id", "category_id")
    box = [F.count("*").alias("area"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h")]
    parts = stuff.groupBy("image_id", "category_id").agg(*box).withColumn("inst_id", F.lit(0)).unionByName(inst.groupBy("image_id", "category_id", "inst_id").agg(*box))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("inst_id") > 0, "category_id", "inst_id"))
    segments = parts.withColumn("seg_id", number.cast("bigint"))
    named = segments.select("image_id", "category_id", "inst_id", "seg_id")
    under = stuff.select("image_id", "y", "x", "category_id").join(named.filter("inst_id = 0").drop("inst_id"), ["image_id", "category_id"]).select("image_id", "y", "x", F.col("seg_id").alias("_s"))
    over = inst.select("image_id", "y", "x", "inst_id", "category_id").join(named.filter("inst_id > 0"), ["image_id", "inst_id", "category_id"]).select("image_id", "y", "x", F.col("seg_id").alias("_i"))
    pixels = px.select("image_id", "y", "x").join(under, ["image_id", "y", "x"], "left").join(over, ["image_id", "y", "x"], "left")
    return pixels.select("image_id", "y", "x", F.coalesce("_i", "_s", F.lit(0)).alias("seg_id")), segments
