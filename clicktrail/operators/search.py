"""Condition search over the stored clicks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.operators.conditions import Mode, SearchCondition, as_condition
from clicktrail.schema import SALT_BUCKETS

Condition = SearchCondition | str | None

# The caller's view of a hit: output name, column, value shown for a missing cell.
_HIT = (
    ("rowKey", "row_key", ""),
    ("accessTime", "access_time", ""),
    ("userId", "user_id", ""),
    ("query", "query", ""),
    ("rank", "rank", 0),
    ("clickOrder", "click_order", 0),
    ("url", "url", ""),
    ("domain", "domain", ""),
)


def hits(logs: DataFrame, condition: Condition = None, mode: Mode = "substring") -> DataFrame:
    """All clicks that meet a condition, in no order."""
    return logs.where(as_condition(condition).to_column(mode, salted="salt" in logs.columns))


def search(
    logs: DataFrame, condition: Condition = None, mode: Mode = "substring", limit: int | None = 100
) -> DataFrame:
    """The first ``limit`` hits in key order; with None all of them, unsorted.

    Key order runs bucket by bucket, within one from the newest click, then by user and domain.
    """
    found = hits(logs, condition, mode)
    return found if limit is None else found.orderBy("row_key").limit(limit)


def to_result(clicks: DataFrame, with_key: bool = True) -> DataFrame:
    """Hits under their outward names, missing cells as ``""`` or 0."""
    shown = _HIT if with_key else _HIT[1:]
    return clicks.select(*(F.coalesce(F.col(c), F.lit(empty)).alias(name) for name, c, empty in shown))


def search_count(logs: DataFrame, condition: Condition = None, mode: Mode = "substring", cap: int = 100) -> DataFrame:
    """One row: the number of hits, and whether it is over ``cap``."""
    counted = hits(logs, condition, mode).agg(F.count("*").alias("hits"))
    return counted.select("hits", (F.col("hits") > cap).alias("over_cap"))


def search_summary(logs: DataFrame, condition: Condition = None, mode: Mode = "like", k: int = 10) -> DataFrame:
    """The ``k`` most frequent (user, query, domain) among the hits."""
    keys = ("user_id", "query", "domain")
    counted = hits(logs, condition, mode).groupBy(*keys).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), *keys).limit(k)


# Digits of time that one look tells apart: at most 10,000 key prefixes.
_DIGITS = 4
# Length of a key up to the end of its time.
_TIMED = 22
# Rows that one task may sort for a page besides its own.
_SORTED = 10_000


def page(found: DataFrame, number: int, size: int = 20) -> DataFrame:
    """Page ``number``, from 1, of hits in key order.

    A first job counts the hits of the first salt, which a page near the start needs only; a second one those of all other
    salts, at most 15 rows. Where many rows of a salt come before the page, one more job counts them per key prefix, beyond
    what its first and last key have in common, so that no task sorts them all; longer prefixes are only looked at where
    one of these holds too many rows.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    skip = (number - 1) * size
    counts = _per_salt(found.where(F.col("salt") == 0))
    if sum(n for n, _, _ in counts.values()) < skip + size:
        counts |= _per_salt(found.where(F.col("salt") > 0))
    before, first, last = 0, None, 0
    for last, (n, _, _) in sorted(counts.items()):
        if first is None and skip < before + n:
            first, skip_in = last, skip - before
        before += n
        if before >= skip + size:
            break
    if first is None:
        return found.limit(0)
    shared = len(os.path.commonprefix(counts[first][1:]))
    start, skip_in = _narrowed(found.where(F.col("salt") == first), skip_in, shared)
    rest = found.where(F.col("salt").between(first, last) & (F.col("row_key") >= start))
    return rest.orderBy("row_key").offset(skip_in).limit(size)


def _per_salt(found: DataFrame) -> dict[int, tuple[int, str, str]]:
    """Number of hits, first and last key of each salt."""
    key = F.substring("row_key", 1, _TIMED)
    counted = found.groupBy("salt").agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    return {r["salt"]: (r["n"], r["low"], r["high"]) for r in counted.collect()}


def _narrowed(inside: DataFrame, skip: int, shared: int) -> tuple[str, int]:
    """A key prefix from which few rows have to be skipped, and how many; all keys share their first letters."""
    start = ""
    for length in range(shared + _DIGITS, _TIMED + _DIGITS, _DIGITS):
        if skip <= _SORTED:
            break
        prefix = F.substring("row_key", 1, min(length, _TIMED)).alias("prefix")
        for start, n in inside.groupBy(prefix).agg(F.count("*").alias("n")).orderBy("prefix").collect():
            if skip < n:
                break
            skip -= n
        inside = inside.where(F.col("row_key").startswith(start))
    return start, skip


def page_after(found: DataFrame, last_key: str | None, size: int = 20) -> DataFrame:
    """The page that follows the row ``last_key``.

    Only salts from the key's own up to the one that fills the page are read.
    """
    rest = found if last_key is None else found.where(F.col("row_key") > last_key)
    digits = (last_key or "00")[:2]
    first = int(digits) if digits.isascii() and digits.isdigit() else 0
    last, counted = first, 0
    for last in range(first, SALT_BUCKETS):
        counted += rest.where(F.col("salt") == last).limit(size).count()
        if counted >= size:
            break
    return rest.where(F.col("salt").between(first, last)).orderBy("row_key").limit(size)


def page_info(found: DataFrame, number: int, size: int = 20) -> DataFrame:
    """One row: hits, number of pages, and the rows (from 1) that page ``number`` shows."""
    n = F.col("hits")
    return found.agg(F.count("*").alias("hits")).select(
        "hits",
        F.ceil(n / size).cast("bigint").alias("pages"),
        F.least(n, F.lit((number - 1) * size + 1).cast("bigint")).alias("first_row"),
        F.least(n, F.lit(number * size).cast("bigint")).alias("last_row"),
    )
