"""Sources and sinks: annotation documents, frames, id maps, rasters, category dimensions; Parquet and JSON outputs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import annotations as ann
from ..operators import sampling
from . import jsonsplit

SEGMENT = "struct<id:bigint,category_id:int,area:bigint,bbox:array<int>,iscrowd:int>"
IMAGE = "id string, file_name string, height int, width int"
NAMED = "struct<id:bigint,category_id:bigint,area:bigint,bbox:array<int>,iscrowd:int,isthing:boolean>"
CATEGORY = "id bigint, name string, isthing int, color array<int>"
RLE = "struct<size:array<int>,counts:array<bigint>>"
PANOPTIC = f"image_id string, file_name string, segments_info array<{SEGMENT}>"
INSTANCE = f"id bigint, image_id string, iscrowd int, category_id int, bbox array<double>, segmentation {RLE}, area double, visibility_fraction double"
FRAME_ANNOTATIONS = "array<struct<category_id:int,bbox:array<double>,iscrowd:int,visibility_fraction:double>>"


def read_panoptic_json(spark: SparkSession, path: str, categories: DataFrame, image_dir: str, label_dir: str, semantic_dir: str | None = None, cast_image_id: bool = False) -> DataFrame:
    """One row an annotation: image and label paths, and segments with contiguous category ids and isthing.

    Segments of unknown categories keep a null contiguous_id; ann.unknown_ids lists them."""
    rows = jsonsplit.arrays(spark, path, {"annotations": PANOPTIC})[0]
    stem = codes.stem_last_dot(F.col("file_name"))
    known = ann.to_contiguous(categories.select(F.col("id").alias("category_id")).distinct(), categories)
    known = known.groupBy(F.col("category_id").cast("bigint").alias("k")).agg(F.min(F.struct("contiguous_id", "isthing")).alias("v")).filter("k is not null")
    known = known.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("known"))  # a dimension of some hundred rows
    item = lambda s: F.struct(s["id"].alias("id"), F.col("known")[s["category_id"].cast("bigint")]["contiguous_id"].alias("category_id"), *[s[c].alias(c) for c in ("area", "bbox", "iscrowd")], F.col("known")[s["category_id"].cast("bigint")]["isthing"].alias("isthing"))
    segments = F.transform(F.filter("segments_info", lambda s: s["id"].isNotNull()), item)
    return rows.crossJoin(F.broadcast(known)).select(
        (F.col("image_id").cast("bigint") if cast_image_id else F.col("image_id")).alias("image_id"),
        F.concat(F.lit(image_dir + "/"), stem, F.lit(".jpg")).alias("file_name"), F.concat(F.lit(label_dir + "/"), F.col("file_name")).alias("pan_seg_file_name"),
        *([] if semantic_dir is None else [F.concat(F.lit(semantic_dir + "/"), F.col("file_name")).alias("sem_seg_file_name")]),
        F.coalesce(segments, F.array().cast(f"array<{NAMED}>")).alias("segments_info"),
    )


def read_instance_json(spark: SparkSession, path: str) -> DataFrame:
    """One row an annotation, with its image's file name and size; images and annotations of one document belong together."""
    images, rows = jsonsplit.arrays(spark, path, {"images": IMAGE, "annotations": INSTANCE})
    images = images.select("file", F.col("id").alias("image_id"), "file_name", "height", "width")
    keys = ["image_id", "file"]  # ids first: paths share long beginnings, so they sort slowly
    parts = rows.rdd.getNumPartitions()  # as many as tasks that read, so that what one sorts does not grow with the documents
    return rows.drop("at").repartition(parts, *keys).join(images.repartition(parts, *keys), keys).drop("file")


def read_categories_json(spark: SparkSession, path: str) -> DataFrame:
    """The categories of a document, numbered in its order: a dimension of some hundred rows."""
    [rows] = jsonsplit.arrays(spark, path, {"categories": CATEGORY})
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1).select("pos", "id", "name", "isthing", "color")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """A category dimension that the user keeps as Parquet or CSV."""
    return spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)


def frames_with_annotations(frames: DataFrame, fraction: float = 1.0, schema: str = FRAME_ANNOTATIONS, group: str | None = None) -> DataFrame:
    """image_id, path, size and parsed annotations of (path, height, width, coco_annotations): sampled, then numbered.

    Numbers run by (group, path); the group defaults to the folder, so no global sort is needed."""
    kept = sampling.stride_sample(frames, fraction, "path", group)
    parsed = kept.withColumn("annotations", F.from_json("coco_annotations", schema)).drop("coco_annotations")
    if group is not None:
        return ann.global_numbers(parsed, group, "path", "image_id", 0)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return ann.global_numbers(parsed.withColumn("_g", folder), "_g", "path", "image_id", 0).drop("_g")


def exploded_annotations(frames: DataFrame) -> DataFrame:
    return frames.select("image_id", F.explode_outer("annotations").alias("a")).select("image_id", "a.*")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, height, width, nChannels and bytes of 8-bit PNG or JPEG files, decoded in the JVM."""
    image = spark.read.format("image").option("dropInvalid", True).load(path)
    origin = F.col("image.origin")
    return image.select(origin.alias("path"), codes.stem_last_dot(origin).alias("stem"), "image.height", "image.width", "image.nChannels", F.col("image.data").alias("data"))


def _pixel_batches(batches: Iterable[pa.RecordBatch], rgb: bool) -> Iterator[pa.RecordBatch]:
    """The pixels of each image as a view of its bytes, some million a batch."""
    for batch in batches:
        stems, data = batch.column("stem"), batch.column("data")
        for i, (h, w, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("height", "width", "nChannels")))):
            px = np.frombuffer(data[i].as_buffer(), np.uint8)[: h * w * n].reshape(h * w, n)
            label = px[:, 2] + px[:, 1].astype(np.int64) * 256 + px[:, 0].astype(np.int64) * 65536 if rgb else px[:, 0]
            for a in range(0, h * w, 1 << 20):
                p = np.arange(a, min(a + (1 << 20), h * w))
                stem = stems.take(pa.array(np.full(len(p), i)))
                yield pa.RecordBatch.from_arrays([stem, pa.array(p // w), pa.array(p % w), pa.array(label[p].astype(np.int64))], names=["stem", "y", "x", "label"])


def raster_pixels(images: DataFrame, channels: str = "grey") -> DataFrame:
    """(stem, y, x, label) of decoded images: `grey` is the first byte, `rgb_id` packs colour; bytes are BGR, row-major.

    Images without bytes give no pixels."""
    rows = images.select(F.col("stem").cast("string").alias("stem"), "height", "width", "nChannels", "data").filter("data is not null and height > 0 and width > 0")
    return rows.mapInArrow(lambda it: _pixel_batches(it, channels != "grey"), "stem string, y bigint, x bigint, label bigint")


def paired_by_stem(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    return a.join(b, "stem", how)


def inventory(images: DataFrame) -> DataFrame:
    return images.select("stem", codes.basename(F.col("path")).alias("file_name"), "height", "width")


def read_id_map(spark: SparkSession, path: str, key_shift: int = 0, value_shift: int = -1) -> DataFrame:
    """(ins_id, sem_id) of a white-space separated text file with a header; a later line replaces an earlier one."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return ann.read_id_map_lines(lines, key_shift, value_shift)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """stem, category_id and run lengths of a list of predicted segments, `seq` in order of the list."""
    [rows] = jsonsplit.arrays(spark, path, {"": f"file_name string, category_id int, segmentation {RLE}"})
    return rows.select(codes.stem_first_dot(F.col("file_name")).alias("stem"), "category_id", F.col("segmentation").alias("rle"), F.col("at").alias("seq"))


def read_detections(spark: SparkSession, path: str, drop_boxes: bool = False, lines: bool = False) -> DataFrame:
    """Detections of a document that is a list, or of JSON lines as write_detections leaves them."""
    schema = f"image_id bigint, category_id int, bbox array<double>, score double, segmentation {RLE}"
    rows = spark.read.schema(schema).json(path) if lines else jsonsplit.arrays(spark, path, {"": schema})[0].drop("file", "at")
    return rows.drop("bbox") if drop_boxes else rows


def write_instances(images: DataFrame, categories: DataFrame, annotations: DataFrame, path: str, kind: str = "parquet") -> None:
    """An annotation set as three tables below path: Parquet, or JSON lines with kind "json"."""
    for name, df in (("images", images), ("categories", categories), ("annotations", annotations)):
        df.write.mode("overwrite").format(kind).save(f"{path}/{name}")


def panoptic_documents(segments: DataFrame, *more: str) -> DataFrame:
    """One row an image: file name and its segments in order of id; `more` columns of an image go along."""
    item = F.sort_array(F.collect_list(F.struct(F.col("seg_id").alias("id"), "category_id", "area", F.array("x", "y", "w", "h").alias("bbox"), F.lit(0).alias("iscrowd"))))
    return segments.groupBy("image_id", *more).agg(item.alias("segments_info")).withColumn("file_name", F.concat(F.col("image_id").cast("string"), F.lit(".png")))


def write_rasters(px: DataFrame, path: str, split: str = "split") -> None:
    px.write.mode("overwrite").partitionBy(split).parquet(path)


def write_detections(det: DataFrame, path: str) -> None:
    det.write.mode("overwrite").json(path)
