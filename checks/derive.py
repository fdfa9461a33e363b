"""Inputs derived from the given tables: raw click lines, a task log, and the stored click table.

The given tables hold no search log, so every row of ``events`` (with the URL of a page) becomes a click
line, some of them damaged and some delivered twice; ``FIXTURES.md`` has the rules. ``checks.oracle``
derives the same in SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.operators import clicks, latest, parse_lines
from clicktrail.plans import parsed_files
from clicktrail.sources import read_logs, write_logs
from clicktrail.sources.scratch import new_path

REDELIVERY = 10_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tabbed(*parts: Column | str) -> Column:
    return F.concat_ws("\t", *parts)


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click lines as (line_no, line)."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit(".example."), F.lit(".")).alias("url"))
    event = F.col("event_id")
    kind = F.when(event % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    events = (
        _table(spark, sf_dir, "events")
        .withColumn("page_id", event % pages.agg(F.count("*")).scalar())
        .join(pages, "page_id")
        .select(
            "event_id",
            "url",
            F.substring(F.col("ts").cast("string"), 12, 8).alias("tm"),
            F.concat(F.lit("user"), "user_id").alias("usr"),
            F.concat(F.lit("["), kind, (event % 23).cast("string"), F.lit("]")).alias("qry"),
            (1 + event % 15).cast("string").alias("rank"),
            (1 + event % 7).cast("string").alias("click"),
            (event % 97).alias("fault"),
        )
    )
    numbers = F.concat_ws(" ", "rank", "click")
    fault = F.col("fault")
    line = (
        F.when(fault == 0, _tabbed("tm", "usr", "qry", numbers))
        .when(fault == 1, _tabbed("tm", F.lit(""), "qry", numbers, "url"))
        .when(fault == 2, _tabbed("tm", "usr", "qry", F.concat_ws(" ", F.lit("x"), "click"), "url"))
        .when(fault == 3, _tabbed("tm", "usr", "qry", "rank", "url"))
        .when(fault == 4, _tabbed(F.substring("tm", 1, 5), "usr", "qry", numbers, "url"))
        .when(fault == 5, _tabbed(F.concat(F.lit("aa"), F.substring("tm", 3, 6)), "usr", "qry", numbers, "url"))
        .otherwise(_tabbed("tm", "usr", "qry", numbers, "url"))
    )
    again = F.when(
        (event % 11 == 0) & (fault > 5),
        F.struct(
            (event + REDELIVERY).alias("line_no"),
            _tabbed("tm", "usr", "qry", F.lit("99 9"), "url").alias("line"),
        ),
    )
    delivered = F.array_compact(F.array(F.struct(event.alias("line_no"), line.alias("line")), again))
    return events.select(F.inline(delivered))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed click lines, straight from the tables and with their line numbers."""
    return parse_lines(raw_lines(spark, sf_dir))


def task_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task log lines as (line_no, line): a task per event, most of them with an end."""
    event = F.col("event_id")
    number = event.cast("string")
    user = F.col("user_id").cast("string")
    kind = (
        F.when(F.col("event_type") == "purchase", "DATA_LOAD")
        .when(F.col("event_type") == "click", "SPARK_SEARCH")
        .when(F.col("event_type") == "signup", "CLEAN_TABLE")
        .otherwise("SPARK_ANALYSIS")
    )
    events = _table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        "user_id",
        kind.alias("kind"),
        F.substring(F.col("ts").cast("string"), 1, 19).alias("at"),
        F.concat_ws("_", kind, number).alias("task"),
    )
    details = (
        F.when(
            F.col("kind") == "DATA_LOAD",
            F.concat(F.lit("file=f"), user, F.lit(".tsv,zk=h:1,batch="), (event % 7 * 1000).cast("string"), F.lit(",encoding=UTF-8")),
        )
        .when(F.col("kind") == "SPARK_SEARCH", F.concat(F.lit("condition=user:user"), user, F.lit("|user1,zkQuorum=h")))
        .when(F.col("kind") == "CLEAN_TABLE", "")
        .otherwise(F.concat(F.lit("start=00:00:00,end=23:59:59,x, start = 0"), (event % 9).cast("string"), F.lit(":00:00")))
    )
    failed = F.col("event_type") == "error"
    start = F.concat_ws("|", "at", "task", F.lit("START"), "kind", details)
    end = F.when(
        event % 13 != 0,
        F.concat_ws(
            "|", "at", "task", F.when(failed, "FAILURE").otherwise("SUCCESS"), "kind", F.when(failed, "refused").otherwise("ok")
        ),
    )
    trace = F.when(event % 1_000_003 == 3, F.concat(F.lit("stack trace of "), number)).when(
        event % 29 == 4, F.concat(F.lit("  at frame "), number)
    )
    written = F.filter(
        F.array(
            *(
                F.struct((event * 3 + i).alias("line_no"), text.alias("line"))
                for i, text in enumerate((start, end, trace))
            )
        ),
        lambda r: r["line"].isNotNull(),
    )
    return events.select(F.inline(written))


_built: dict[tuple[str, ...], str] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, build) -> str:
    """Path of something written once per application; known only after its job has committed."""
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), what)
    if key not in _built:
        path = new_path(spark, what)
        build(path)
        _built[key] = path
    return _built[key]


def raw_files(spark: SparkSession, sf_dir: str, delivery: int | None = None) -> str:
    """The click lines as text files in line order; all of them, or those of one delivery."""

    def build(path: str) -> None:
        ordered = raw_lines(spark, sf_dir).repartitionByRange("line_no").sortWithinPartitions("line_no")
        numbered = ordered.select("line", F.when(F.col("line_no") < REDELIVERY, 1).otherwise(2).alias("delivery"))
        numbered.write.partitionBy("delivery").text(path)

    path = _once(spark, sf_dir, "raw", build)
    return path if delivery is None else f"{path}/delivery={delivery}"


def loaded(spark: SparkSession, sf_dir: str, delivery: int | None = None) -> DataFrame:
    """Parsed click lines as a load reads them from the files."""
    return parsed_files(spark, raw_files(spark, sf_dir, delivery))


def task_files(spark: SparkSession, sf_dir: str) -> str:
    """The task log under a folder, named as the log reader expects."""

    def build(path: str) -> None:
        ordered = task_lines(spark, sf_dir).repartitionByRange("line_no").sortWithinPartitions("line_no")
        ordered.select("line").write.text(f"{path}/tasks_all.log")

    return _once(spark, sf_dir, "tasks", build)


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored click table, loaded from the text files and written by the library."""

    def build(path: str) -> None:
        write_logs(latest(clicks(loaded(spark, sf_dir))), path)

    return read_logs(spark, _once(spark, sf_dir, "logs", build))
