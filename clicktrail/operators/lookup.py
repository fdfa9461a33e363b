"""Reads by row key and by time. All of them skip partitions or row groups at the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.functions.keys import salt_of, salt_of_key
from clicktrail.functions.times import bound_to_ms
from clicktrail.schema import SALT_BUCKETS


def scan_time_range(logs: DataFrame, start: str, end: str) -> DataFrame:
    """Clicks of ``start`` to ``end``, both inclusive, by parsed time; exact in every salt."""
    return logs.where(F.col("ts_ms").between(bound_to_ms(start), bound_to_ms(end)))


def _salt_literal(prefix: str) -> int | None:
    digits = prefix[:2]
    return int(digits) if len(digits) == 2 and digits.isascii() and digits.isdigit() else None


def get_by_key(logs: DataFrame, key: str) -> DataFrame:
    """The click with this row key: one partition, and within it one row group."""
    number = _salt_literal(key)
    if number is None:
        return logs.where(F.lit(False))
    return logs.where((F.col("salt") == number) & (F.col("row_key") == key))


def get_by_keys(logs: DataFrame, keys: Sequence[str] | DataFrame) -> DataFrame:
    """Clicks of many keys, in the order of the keys; keys without a row drop out.

    ``keys`` is a list, or a DataFrame of (pos, row_key) of any size; the join goes by size. A list's range of
    keys in each salt, at most 16, is tested at the scan.
    """
    if isinstance(keys, DataFrame):
        wanted = keys.select("pos", "row_key")
    else:
        wanted = logs.sparkSession.createDataFrame(list(enumerate(keys)), "pos bigint, row_key string")
        spans: dict[int, list[str]] = {}
        for key in keys:
            number = _salt_literal(key)
            if number is not None:
                spans[number] = [min(key, *spans.get(number, [key])), max(key, *spans.get(number, [key]))]
        inside = [(F.col("salt") == s) & F.col("row_key").between(low, high) for s, (low, high) in spans.items()]
        logs = logs.where(reduce(or_, inside) if inside else F.lit(False))
    wanted = wanted.withColumn("salt", salt_of_key("row_key"))
    return logs.join(wanted, ["salt", "row_key"]).orderBy("pos").select(*logs.columns)


def search_by_key_parts(
    logs: DataFrame,
    prefix: str | None = None,
    access_time: str | None = None,
    user: str | None = None,
    domain: str | None = None,
) -> DataFrame:
    """Clicks whose key starts with ``prefix`` and has the given time, user and domain; all optional."""
    tests: list[Column] = []
    if prefix:
        tests.append(F.col("row_key").startswith(prefix))
        if len(prefix) >= 2:
            number = _salt_literal(prefix)
            tests.append(F.lit(False) if number is None else F.col("salt") == number)
        elif prefix.isascii() and prefix.isdigit():
            tests.append(F.col("salt").isin([s for s in range(SALT_BUCKETS) if f"{s:02d}".startswith(prefix)]))
    if access_time is not None:
        tests.append(F.col("ts_ms") == bound_to_ms(access_time))
    if user is not None:
        tests.append((F.col("salt") == salt_of(user)) & (F.col("user_id") == user))
    if domain is not None:
        tests.append(F.col("domain") == domain)
    return logs.where(reduce(and_, tests)) if tests else logs
