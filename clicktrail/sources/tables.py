"""The stored click table: Parquet, a partition per load and salt, rows in key order within each file.

A load only adds its own rows, so that its cost follows the load and not the table. Readers take the last row of
each key; ``compact_table`` merges all loads into one, ``drop_replaced`` removes what no reader needs any more. A small
log says which loads count: an entry is written after all of a load's rows, and readers look there when they run.
Folders without loads (``write_logs``) hold each key once.
"""

from __future__ import annotations

import time
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.operators.merge import key_ordered, last_of, latest
from clicktrail.schema import LOG_COLUMNS, LOGS

BYTES_PER_FILE = 256 << 20
BROADCAST_ROWS = 1_000_000
"""Rows of later loads whose keys may be broadcast."""
LOG_OF_LOADS = "kind string, at bigint, rows bigint, held bigint, member string"
ADDED, MERGED = "load", "merge"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Stored clicks under a path. The schema is fixed, so no file is opened to plan the read."""
    return spark.read.schema(LOGS).parquet(path).select(*LOG_COLUMNS)


def write_logs(df: DataFrame, path: str, mode: str = "error", partitions: int | None = None) -> None:
    """Write clicks that are unique by row key to a path, in ``partitions`` key ranges."""
    key_ordered(df.select(*LOG_COLUMNS), partitions).write.mode(mode).partitionBy("salt").parquet(path)


def partitions_for(spark: SparkSession, path: str | list[str], bytes_per_file: int = BYTES_PER_FILE) -> int:
    """Key ranges for what is read from files, by their sizes; no content is read for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return max(1, -(-(files.agg(F.sum("length")).first()[0] or 0) // bytes_per_file))


def _part(name: str, what: str) -> str:
    return f"{name}__{what}"


def create_table(spark: SparkSession, name: str, buckets: int = 16) -> None:
    """Create the catalog table where it is missing, with two more beside it.

    ``<name>`` takes the loads; ``<name>__base`` the merged ones, in ``buckets`` buckets of the row key, sorted, so that
    later loads are merged in without a shuffle of the base: take some as many as there are cores. ``<name>__log`` says
    which loads count, and which of them a merged load holds.
    """
    if not spark.catalog.tableExists(name):
        for what in ("base", "log"):
            spark.sql(f"DROP TABLE IF EXISTS {_part(name, what)}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in LOGS if f.name != "salt")
    logs = f"({columns}, `load` string, `salt` int) USING parquet PARTITIONED BY (`load`, `salt`)"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_part(name, 'log')} ({LOG_OF_LOADS}, `load` string) USING parquet PARTITIONED BY (`load`)")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_part(name, 'base')} {logs} CLUSTERED BY (`row_key`) SORTED BY (`row_key`) INTO {buckets} BUCKETS")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} {logs}")


def clear_table(spark: SparkSession, name: str) -> bool:
    """Remove all rows and keep the schema; False where there is no such table."""
    if not spark.catalog.tableExists(name):
        return False
    for what in (_part(name, "log"), _part(name, "base"), name):
        spark.sql(f"TRUNCATE TABLE {what}")
    return True


def drop_table(spark: SparkSession, name: str) -> None:
    """Remove the table with its base, its log and a claim that may be left."""
    spark.sql(f"DROP VIEW IF EXISTS {_part(name, 'claim')}")
    for what in (_part(name, "log"), _part(name, "base"), name):
        spark.sql(f"DROP TABLE IF EXISTS {what}")


def _partitions(spark: SparkSession, table: str) -> list[dict[str, str]]:
    """Partition values of a catalog table: at most 16 for each load that was not dropped yet."""
    found = (r[0].split("/") for r in spark.sql(f"SHOW PARTITIONS {table}").collect())
    return [dict(p.split("=", 1) for p in parts) for parts in found]


def _state(log: DataFrame) -> DataFrame:
    """What counts, as one row: the merged load to start from (``base``) with the number of loads that it ``held``; where
    there is none, the ``first`` load; and the ``later`` loads in the order of their commits, with their ``rows``.

    Of several merged loads the one that holds most counts, whatever other compactions did at the same time: each holds all
    the loads committed before it looked. A load that committed afterwards is later than all of a merged load, and no merged
    load but the base is read, so a row is never counted twice.
    """
    known = log.groupBy("load", "kind").agg(F.max("at").alias("at"), F.max("rows").alias("rows"), F.max("held").alias("held"), F.collect_set("member").alias("members"))
    merged = F.col("kind") == MERGED
    base = F.max_by(F.when(merged, F.struct("load", "members", "held")), F.when(merged, F.struct("held", "load"))).alias("base")
    plain = F.array_sort(F.collect_list(F.when(~merged, F.struct("at", "load", "rows")))).alias("plain")
    live = F.filter("plain", lambda p: ~F.array_contains(F.coalesce(F.col("base.members"), F.array().cast("array<string>")), p["load"]))
    one = known.agg(base, plain).withColumn("live", live)
    with_base = F.col("base").isNotNull()
    later = F.when(with_base, F.col("live")).otherwise(F.slice("live", F.lit(2), F.greatest(F.size("live") - 1, F.lit(0))))
    one = one.withColumn("later", later)
    return one.select(
        F.col("base.load").alias("base"),
        F.coalesce("base.held", F.lit(0)).alias("held"),
        F.when(~with_base, F.get("live", F.lit(0))["load"]).alias("first"),
        F.transform("later", lambda p: p["load"]).alias("later"),
        F.aggregate("later", F.lit(0).cast("bigint"), lambda n, p: n + p["rows"]).alias("rows"),
    )


def loads(spark: SparkSession, name: str) -> list[str]:
    """Loads that count, in the order in which they replace one another; the first may be a merged one."""
    now = _state(spark.table(_part(name, "log"))).first()
    return [load for load in (now["base"], now["first"], *now["later"]) if load]


def table_logs(spark: SparkSession, name: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Stored clicks, the last row of each key, as the table is when the rows are asked for.

    The loads that count are found by a subquery over the log when the query runs, and only their partitions are read. The
    base is read without the keys of the later loads, neither grouped nor sorted anew. If the later loads have at most
    ``broadcast_rows`` rows now, their keys are broadcast, and a query run after far more have come fails and says so. Else
    they are shuffled to the base's buckets, and the base stays where it is.
    """
    log = _state(spark.table(_part(name, "log")))
    few = log.first()["rows"] <= broadcast_rows
    return _merged(spark, name, log.select(F.struct("*")).scalar(), broadcast_rows if few else None)


def _merged(spark: SparkSession, name: str, state: Column, broadcast_rows: int | None) -> DataFrame:
    stored = spark.table(name)
    base = spark.table(_part(name, "base")).where(F.col("load") == state["base"]).select(*LOG_COLUMNS)
    first = stored.where(F.col("load") == state["first"]).select(*LOG_COLUMNS)
    added = stored.where(F.array_contains(state["later"], F.col("load")))
    later = last_of(added.withColumn("turn", F.array_position(state["later"], F.col("load"))), "turn")
    # The salt is part of the row key; as a key of its own it prunes partitions, but the base's buckets don't know it.
    on = ["row_key"] if broadcast_rows is None else ["salt", "row_key"]
    newer = added.select(*on).distinct()
    if broadcast_rows is not None:
        grown = F.raise_error(F.lit(f"{name} has more than {4 * broadcast_rows} rows in later loads by now: call table_logs again, or compact_table"))
        newer = F.broadcast(newer.where(F.when(state["rows"] <= 4 * broadcast_rows, True).otherwise(grown.cast("boolean"))))
    old = (part.join(newer, on, "left_anti").select(*LOG_COLUMNS) for part in (base, first))
    return next(old).unionByName(next(old)).unionByName(later)


def _name_of_load(kind: str) -> str:
    return f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}{'' if kind == ADDED else '-' + kind}"


def _commit(spark: SparkSession, name: str, load: str, kind: str, rows: int, held: int, members: list[str]) -> None:
    """Make a load count: one small file in the log, which appears as a whole."""
    entries = [(kind, time.time_ns() // 1000, rows, held, member, load) for member in members or [None]]
    made = spark.createDataFrame(entries, f"{LOG_OF_LOADS}, load string").coalesce(1)
    made.select(*spark.table(_part(name, "log")).columns).write.mode("append").insertInto(_part(name, "log"))


def upsert_table(
    spark: SparkSession, name: str, new: DataFrame, order: str = "load_seq", partitions: int | None = None
) -> str:
    """Add parsed clicks to a catalog table as one load; its rows replace earlier ones of their keys. Returns the load.

    No stored row is read or written. Rows count from the moment the load is in the log, after all of them are written, so
    a load that was killed leaves nothing to see. Of loads that run at once the one that commits last replaces the others.
    """
    create_table(spark, name)
    load = _name_of_load(ADDED)
    laid = key_ordered(latest(new, order).select(*LOG_COLUMNS), partitions).withColumn("load", F.lit(load))
    laid.select(*spark.table(name).columns).write.mode("append").insertInto(name)
    rows = spark.table(name).where(F.col("load") == load).count()
    if rows:
        _commit(spark, name, load, ADDED, rows, 0, [])
    return load


def _claim(spark: SparkSession, name: str, stale_after: timedelta) -> bool:
    """Take the table's claim, a view that only one session can create; one that is too old goes first."""
    claim, now = _part(name, "claim"), time.time_ns() // 1000
    for _ in range(2):
        try:
            spark.sql(f"CREATE VIEW {claim} AS SELECT {now}L AS since")
            return True
        except AnalysisException as e:
            if e.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
                raise
        held = spark.table(claim).first()
        if now - held["since"] <= stale_after / timedelta(microseconds=1):
            return False
        spark.sql(f"DROP VIEW IF EXISTS {claim}")
    return False


def compact_table(spark: SparkSession, name: str, stale_after: timedelta = timedelta(hours=12)) -> str | None:
    """Merge all loads that count into a new one in the base; returns it, or None where there is nothing to merge or
    another compaction holds the claim.

    Readers start from the merged load once it is in the log; a compaction that was killed before leaves them as they were,
    and its claim falls after ``stale_after``. The claim only saves work: two compactions at once are right as well. Nothing
    is removed here, so readers that began before go on; see ``drop_replaced``.
    """
    if not _claim(spark, name, stale_after):
        return None
    try:
        log = spark.table(_part(name, "log"))
        now = _state(log).first()
        new = [load for load in (now["first"], *now["later"]) if load]
        if not new:
            return None
        fixed = F.struct(*(F.lit(now[c]).alias(c) for c in ("base", "first", "rows")), F.lit(now["later"]).cast("array<string>").alias("later"))
        base, load = _part(name, "base"), _name_of_load(MERGED)
        rows = _merged(spark, name, fixed, None).repartition(_buckets(spark, base), "row_key").withColumn("load", F.lit(load))
        rows.select(*spark.table(base).columns).write.mode("append").insertInto(base)
        held = log.where((F.col("load") == now["base"]) & F.col("member").isNotNull())
        members = [r["load"] for r in log.where(F.col("kind") == ADDED).join(held.select(F.col("member").alias("load")), "load", "left_semi").select("load").collect()]
        count = spark.table(base).where(F.col("load") == load).count()
        _commit(spark, name, load, MERGED, count, now["held"] + len(new), members + new)
        return load
    finally:
        spark.sql(f"DROP VIEW IF EXISTS {_part(name, 'claim')}")


def _buckets(spark: SparkSession, table: str) -> int:
    return int(spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Num Buckets'").first()["data_type"])


def drop_replaced(spark: SparkSession, name: str, older_than: timedelta) -> list[str]:
    """Remove loads that a merged load replaced more than ``older_than`` ago, and what loads and compactions that were
    killed longer ago than that have left. Returns what was removed.

    ``older_than`` must be longer than any query and any load runs: a query that still reads such a load fails on the
    missing files, and never returns fewer rows. A query run anew looks up the loads that count then.
    """
    log, before = spark.table(_part(name, "log")), datetime.now(UTC) - older_than
    then = _state(log.where((F.col("kind") == ADDED) | (F.col("at") <= int(before.timestamp() * 1e6)))).first()
    entries = log.select("load", "kind", "held", "member").collect()
    inside = {e["member"] for e in entries if e["load"] == then["base"]}
    replaced = {e["load"] for e in entries if (e["load"] in inside if e["kind"] == ADDED else e["held"] < then["held"])}
    known, started = {e["load"] for e in entries}, f"{before:%Y%m%dT%H%M%S%f}"
    tables = {what: _partitions(spark, what) for what in (name, _part(name, "base"))}
    left = {p["load"] for found in tables.values() for p in found if p["load"] not in known and p["load"] < started}
    for load in sorted(replaced):
        spark.sql(f"ALTER TABLE {_part(name, 'log')} DROP IF EXISTS PARTITION (`load` = '{load}')")
    for what, found in tables.items():
        gone = ", ".join(f"PARTITION (`load` = '{p['load']}', `salt` = {p['salt']})" for p in found if p["load"] in replaced | left)
        if gone:
            spark.sql(f"ALTER TABLE {what} DROP IF EXISTS {gone}")
    return sorted(replaced | left)


def register(df: DataFrame, name: str = "search_logs") -> None:
    """Make clicks known to ``spark.sql`` under a name."""
    df.createOrReplaceTempView(name)


def to_documents(clicks: DataFrame) -> DataFrame:
    """Document form of clicks: nine fields, ``tokens`` always null."""
    return clicks.select(
        F.col("ts_ms").alias("ts"),
        F.col("access_time").alias("tsStr"),
        F.col("user_id").alias("userId"),
        "query",
        "rank",
        F.col("click_order").alias("clickOrder"),
        "url",
        "domain",
        F.lit(None).cast("array<string>").alias("tokens"),
    )


def append_documents(documents: DataFrame, path: str, format: str = "json") -> None:
    """Append documents, every parsed line as one, without collapsing equal keys."""
    writer = documents.write.mode("append").format(format)
    if format == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.save(path)
