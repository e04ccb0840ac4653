"""JSON documents read by many tasks: short ones whole, one task each; of long ones the records of their top-level arrays,
found by prefix sums over byte ranges.

Spark's text source cuts a file into byte ranges and, told that lines end with `}`, into fragments. What a fragment means
depends on all before it only through two numbers: whether it begins inside a string, and how deep it lies. Each fragment
gives the parity of its quotes, and how it changes the depth in either case; sums over the fragments of a range, then
over ranges, give both numbers everywhere. A record begins where the depth is that of the array's elements and ends with
the fragment that returns to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import land

#: Documents of up to so many bytes are read whole.
WHOLE = 4 << 20
#: What precedes the first brace of a fragment: no braces, or strings. Then: the name of an array that begins right there.
_HEAD = r'^((?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+)\{'
_ARRAY = r'"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*$'
_STRING = r'"(?:[^"\\]++|\\.)*+"'
_NAMED = r'"(?:[^"\\]|\\.)*"\s*:'


def _in_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path)


def _fragments(spark: SparkSession, path: str, over: int = -1) -> DataFrame:
    """(file, at, seq, value, odd, out, inside): the fragments of each byte range in order of seq; `odd` is the parity of
    the quotes, the others the change of depth if the fragment begins outside or inside a string."""
    raw = _in_ranges(spark, path).filter(F.col("_metadata.file_size") > over).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"), "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)

    def change(parity: int) -> Column:
        text = F.array_join(F.filter(parts, lambda _, i: i % 2 == parity), "")
        count = lambda signs: F.length(text) - F.length(F.translate(text, signs, ""))
        return (count("{[") - count("}]")).cast("long")

    odd = ((F.size(parts) - 1) % 2).cast("int")
    # the brace that ends a fragment counts if it lies outside a string
    return raw.select("*", odd.alias("odd"), (change(0) - (1 - odd)).alias("out"), (change(1) - odd).alias("inside"))


def records(spark: SparkSession, path: str, depth: int = 2, over: int = -1) -> DataFrame:
    """(file, key, at, text) of the objects in arrays of `depth`: 2 for those of the arrays named in one object, 1 for a document
    that is a list (key ''). `at` orders a file's records; a record may lie in several byte ranges. Only files of more than `over` bytes.

    Documents must be valid JSON, in UTF-8, one a file. Landed twice: the fragments, so that all see the same ones, and the records."""
    parts = land(_fragments(spark, path, over))
    block = Window.partitionBy("file", "at")
    order = block.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("odd").over(order), F.lit(0)) % 2
    rows = parts.withColumns({"begun": before.cast("int"), "i": F.row_number().over(block.orderBy("seq"))})
    for name, flip in (("d0", 0), ("d1", 1)):  # the change of depth if the range begins outside or inside a string
        rows = rows.withColumn(name, F.when((F.col("begun") + flip) % 2 == 0, F.col("out")).otherwise(F.col("inside")))
    blocks = rows.groupBy("file", "at").agg((F.sum("odd") % 2).alias("odd"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    ranges = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row a byte range of a file
    blocks = blocks.withColumn("in0", (F.coalesce(F.sum("odd").over(ranges), F.lit(0)) % 2).cast("int"))
    blocks = blocks.withColumn("deep", F.coalesce(F.sum(F.when(F.col("in0") == 0, F.col("d0")).otherwise(F.col("d1"))).over(ranges), F.lit(0)))
    rows = rows.join(blocks.select("file", "at", "in0", "deep"), ["file", "at"])
    rows = rows.withColumn("change", F.when(F.col("in0") == 0, F.col("d0")).otherwise(F.col("d1")))
    rows = rows.withColumn("level", F.col("deep") + F.coalesce(F.sum("change").over(order), F.lit(0)))
    body = F.when(F.col("level") == 0, F.regexp_replace("value", r"^[\s\x{FEFF}]*\{", "")).otherwise(F.col("value")) if depth > 1 else F.col("value")
    outside = (F.col("in0") + F.col("begun")) % 2 == 0
    rows = rows.select("file", "at", "i", "level", (F.col("level") + F.col("change") == depth).alias("ends"), outside.alias("outside"), body.alias("value"))
    head = F.when(F.col("outside") & F.col("value").rlike(_HEAD), F.regexp_extract("value", _HEAD, 1))
    rows = rows.withColumn("head", head).withColumn("bare", F.regexp_replace("head", _STRING, ""))
    # where the first brace lies: brackets before it may close what was open, and open more
    brace = F.col("level") + F.length(F.regexp_replace("bare", r"[^\[]", "")) - F.length(F.regexp_replace("bare", r"[^\]]", ""))
    if depth > 1:
        brace = brace + F.when(F.col("level") == 0, 1).otherwise(0)
    rows = rows.withColumn("starts", F.coalesce(brace == depth, F.lit(False)))
    first = F.col("outside") & (F.col("starts") | (F.col("level") <= depth))
    named = F.when(F.col("head").rlike(_NAMED), F.regexp_extract("head", _ARRAY, 1)) if depth > 1 else F.lit("")
    rows = rows.select("file", "at", "i", "ends", first, "value", F.when(F.col("starts"), F.length("head")), F.when(first, named)).toDF("file", "at", "i", "ends", "first", "value", "skip", "key")
    # of each fragment the record it belongs to: the last first fragment up to it, in this range or one before
    upto = block.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"own": F.max(F.when(F.col("first"), F.col("i"))).over(upto), "named": F.last("key", True).over(upto)})
    last = rows.groupBy("file", "at").agg(F.max("own").alias("own"), F.max_by("named", "i").alias("named"))
    last = last.select("file", "at", F.last(F.when(F.col("own").isNotNull(), F.struct("at", "own")), True).over(ranges).alias("of"), F.last("named", True).over(ranges).alias("was"))
    rows = rows.join(last, ["file", "at"]).select(
        "file", "at", "i", "ends", "value", "skip", F.coalesce("named", "was").alias("key"),
        F.when(F.col("own").isNotNull(), F.struct("at", "own")).otherwise(F.col("of")).alias("record"),
    )
    single = F.col("ends") & F.col("skip").isNotNull()
    cut = F.concat(F.expr("substring(value, skip + 1)"), F.lit("}"))
    alone = rows.filter(single).select("file", "key", "record", cut.alias("text"))
    part = F.struct("at", "i", F.when(F.col("skip").isNotNull(), cut).otherwise(F.concat("value", F.lit("}"))).alias("value"))
    many = rows.filter(~single).groupBy("file", "record").agg(F.sort_array(F.collect_list(part)).alias("p"), F.max("ends").alias("ends"), F.max("skip").alias("skip"), F.min_by("key", F.struct("at", "i")).alias("key"))
    many = many.filter(F.col("ends") & F.col("skip").isNotNull()).select("file", "key", "record", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("text"))
    # a range holds fewer fragments than bytes, so this number is unique in its file and in order
    return land(alone.unionByName(many).select("file", F.coalesce("key", F.lit("")).alias("key"), (F.col("record.at") + F.col("record.own")).alias("at"), "text"))


def parsed(found: DataFrame, schema: str, key: str = "") -> DataFrame:
    """The records of one array as columns of a schema (DDL of a struct's fields), with `file` and `at`."""
    return found.filter(F.col("key") == key).select("file", "at", F.from_json("text", schema).alias("r")).select("file", "at", "r.*")


def _whole(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The objects in one array of each document of up to WHOLE bytes as columns, with `file` and `at`: plain projections of its text.

    A document is parsed once. Where some value does not fit the schema, its objects are parsed again one by one, so that each loses only its own."""
    docs = spark.read.text(path, wholetext=True).filter(F.col("_metadata.file_size") <= WHOLE)
    text = F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 1 << 30)).otherwise(F.col("value"))
    docs = docs.select(F.col("_metadata.file_path").alias("file"), F.concat(F.lit('{"v":'), text, F.lit("}")).alias("text"))
    of = lambda item: f"v struct<`{key}`:array<{item}>>" if key else f"v array<{item}>"
    items = lambda p: p["v"][key] if key else p["v"]
    docs = docs.select("file", "text", F.from_json("text", of(f"struct<{schema}>") + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("p"))
    single = F.filter(items(F.from_json("text", of("string"))), lambda x: F.startswith(x, F.lit("{")))
    found = F.when(F.col("p._bad").isNull(), items(F.col("p"))).otherwise(F.transform(single, lambda x: F.from_json(x, schema)))
    return docs.select("file", F.posexplode(found).alias("at", "r")).filter("r is not null").select("file", F.col("at").cast("bigint").alias("at"), "r.*")


def arrays(spark: SparkSession, path: str, schemas: dict[str, str]) -> list[DataFrame]:
    """For each array, by its key ('' alone: documents that are lists) and schema, its objects as columns, with `file` and `at`.

    Documents must be valid JSON, in UTF-8, one a file. Short ones are neither shuffled nor landed."""
    found = [_whole(spark, path, schema, key) for key, schema in schemas.items()]
    if _in_ranges(spark, path).filter(F.col("_metadata.file_size") > WHOLE).isEmpty():  # decided by the listing, no such file is read
        return found
    cut = records(spark, path, 1 if "" in schemas else 2, WHOLE)
    return [whole.unionByName(parsed(cut, schema, key)) for whole, (key, schema) in zip(found, schemas.items())]
