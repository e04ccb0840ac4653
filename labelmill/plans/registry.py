"""The registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import box_queries, decode_queries, io_queries, mask_queries, raster_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**raster_queries.Q, **box_queries.Q, **decode_queries.Q, **io_queries.Q, **mask_queries.Q}
ORACLE_SQL: dict[str, str] = {**raster_queries.SQL, **box_queries.SQL, **decode_queries.SQL, **io_queries.SQL, **mask_queries.SQL}
