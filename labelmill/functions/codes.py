"""Label codes, colour ids and path parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shifted_label(v: Column) -> Column:
    """v - 1 with unsigned 8-bit wrap: 0 becomes 255."""
    return F.pmod(v - 1, F.lit(256))


def rgb_to_id(r: Column, g: Column, b: Column) -> Column:
    return r.cast("bigint") + g.cast("bigint") * 256 + b.cast("bigint") * 65536


def id_to_rgb(i: Column) -> list[Column]:
    return [F.pmod(i, F.lit(256)), F.pmod(F.floor(i / 256), F.lit(256)), F.floor(i / 65536)]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_first_dot(path: Column) -> Column:
    return F.substring_index(basename(path), ".", 1)


def stem_last_dot(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def with_extension(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""), F.lit(extension))


def split_flat_index(i: Column, width: int) -> tuple[Column, Column]:
    return F.floor(i / width).cast("bigint"), (i % width).cast("bigint")
