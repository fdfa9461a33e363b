"""Upsert by row key: the later line wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.schema import LOG_COLUMNS

KEY = ("salt", "row_key")


def _last_per_key(rows: DataFrame, order: str, key: tuple[str, ...]) -> DataFrame:
    cells = [c for c in LOG_COLUMNS if c not in key]
    last = F.max_by(F.struct(*cells), order).alias("last")
    return rows.groupBy(*key).agg(last).select(*key, "last.*").select(*LOG_COLUMNS)


def latest(new: DataFrame, order: str = "load_seq") -> DataFrame:
    """One row per row key, the one with the greatest ``order`` value.

    Combined before the shuffle: a key that repeats without end sends one row per task. The row key tells
    the time, so grouping by time as well changes nothing, but sorts faster: row keys all begin alike.
    """
    return _last_per_key(new, order, ("ts_ms", *KEY))


def _both(existing: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Stored and new rows, no more than two per key, marked with their turn."""
    stored = existing.select(*LOG_COLUMNS, F.lit(0).alias("turn"))
    return stored.unionByName(latest(new, order).withColumn("turn", F.lit(1)))


def upsert(existing: DataFrame, new: DataFrame, order: str = "load_seq") -> DataFrame:
    """``existing`` with the rows of ``new`` added; a row of ``new`` replaces the one with its key.

    ``order`` is a column of ``new``, unique within it. Stored rows precede all of it.
    """
    return _last_per_key(_both(existing, new, order), "turn", ("ts_ms", *KEY))


def last_of(rows: DataFrame, order: str) -> DataFrame:
    """Stored rows of several loads, the last of each key by ``order``."""
    return _last_per_key(rows, order, ("ts_ms", *KEY))


def key_ordered(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Lay rows out for writing: ranges of the row key, sorted within each task.

    A task then writes to one or two salts only, a file covers a short span of time of day (so footer
    statistics prune on row_key, ts_ms and access_time) and a user with a large share of all rows is cut
    into several ranges, as the key also holds the time. ``partitions`` should follow the size of the rows;
    without it ``spark.sql.shuffle.partitions`` counts, merged by adaptive execution where small.
    """
    ranged = rows.repartitionByRange(*KEY) if partitions is None else rows.repartitionByRange(partitions, *KEY)
    return ranged.sortWithinPartitions(*KEY)
