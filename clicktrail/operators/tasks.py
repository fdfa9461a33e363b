"""Analysis of the task log: ``timestamp|task id|STATUS|type|details`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.schema import TASK_LOG

STARTED = "START"
ENDED = ("SUCCESS", "FAILURE")


def parse_task_log(lines: DataFrame) -> DataFrame:
    """Task records with the other columns of ``lines`` (their order) carried along.

    Four parts have empty details; fewer make no record. Pipes in the details stay.
    """
    carried = [c for c in lines.columns if c != "line"]
    parts = lines.select(*carried, F.split("line", r"\|", 5).alias("p")).where(F.size("p") >= 4)
    fields = (F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(f.name) for i, f in enumerate(TASK_LOG))
    return parts.select(*carried, *fields)


def incomplete_tasks(records: DataFrame, order: str = "load_seq") -> DataFrame:
    """Tasks that started and neither succeeded nor failed, with their first start.

    One grouping by task id instead of an anti join: it is combined before the shuffle, so a task that
    fills the log does no harm. ``starts`` counts the start lines of the task. Lines with nothing after
    the status do not count.
    """
    counted = records.where((F.col("type") != "") | (F.translate("details", "|", "") != ""))
    is_start = F.col("status") == STARTED
    per_task = counted.groupBy("task_id").agg(
        F.count_if(is_start).alias("starts"),
        F.count_if(F.col("status").isin(*ENDED)).alias("ends"),
        F.min_by(F.when(is_start, F.struct("ts", "type", "details")), F.when(is_start, F.col(order))).alias("first"),
    )
    return per_task.where((F.col("starts") > 0) & (F.col("ends") == 0)).select("task_id", "starts", "first.*")


def task_info(records: DataFrame, task_id: str, order: str = "load_seq") -> DataFrame:
    """Type and parameters of a task by its first start line."""
    starts = records.where((F.col("task_id") == task_id) & (F.col("status") == STARTED))
    return starts.orderBy(order).limit(1).select("task_id", "type", F.col("details").alias("parameters"))


def recent_operations(lines: DataFrame, n: int = 10, order: str = "load_seq", lines_first: bool = False) -> DataFrame:
    """The ``n`` newest records.

    With ``lines_first`` the newest lines are picked before those that make no record are dropped, so fewer
    than ``n`` may remain, or none behind a stack trace.
    """
    if lines_first:
        newest = lines.orderBy(F.substring_index("line", "|", 1).desc(), F.asc(order)).limit(n)
        return parse_task_log(newest)
    return parse_task_log(lines).orderBy(F.desc("ts"), F.asc(order)).limit(n)
