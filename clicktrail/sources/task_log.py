"""Files of the task log, named ``tasks_<yyyy-MM-dd>.log``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clicktrail.sources.raw_text import read_raw


def read_task_log(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Lines of all task logs in a folder, or of one day, as (line, load_seq)."""
    return read_raw(spark, f"{path.rstrip('/')}/{f'tasks_{day}' if day else '*'}.log")
