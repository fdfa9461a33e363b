"""Schemas and fixed values of the click-log model."""

from __future__ import annotations

from pyspark.sql import types as T

TABLE = "search_logs"
SALT_BUCKETS = 16
DAY_MS = 86_400_000
LONG_MAX = 9_223_372_036_854_775_807
LONG_MIN = -9_223_372_036_854_775_808

# Reject reasons, in the order in which they are tested.
FIELD_COUNT = "field_count"
REQUIRED_EMPTY = "required_empty"
RANK_CLICK_FORMAT = "rank_click_format"
RANK_CLICK_NUMBER = "rank_click_number"
TIME_FORMAT = "time_format"
TIME_NUMBER = "time_number"
REASONS = (
    FIELD_COUNT,
    REQUIRED_EMPTY,
    RANK_CLICK_FORMAT,
    RANK_CLICK_NUMBER,
    TIME_FORMAT,
    TIME_NUMBER,
)

# One stored click. ``row_key`` is the identity of a row, ``salt`` the partition column.
LOGS = T.StructType(
    [
        T.StructField("row_key", T.StringType()),
        T.StructField("salt", T.IntegerType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("access_time", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("click_order", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("domain", T.StringType()),
    ]
)
LOG_COLUMNS = LOGS.fieldNames()

TASK_LOG = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("details", T.StringType()),
    ]
)
