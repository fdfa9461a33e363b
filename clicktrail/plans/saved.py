"""Saved search results: row keys only, resolved against the table as it is when read."""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.functions.keys import salt_of_key
from clicktrail.operators.conditions import Mode, as_condition
from clicktrail.operators.search import Condition, search

SAVED = "identity string, condition string, row_key string, identity_hash bigint"


def _identity(condition: Condition, mode: Mode, limit: int) -> str:
    return json.dumps([as_condition(condition).identity(), mode, limit])


def save_result(logs: DataFrame, condition: Condition, path: str, limit: int = 100, mode: Mode = "substring") -> None:
    """Save the keys of the first ``limit`` hits under the condition, the mode and the limit.

    An earlier result of the same three is replaced; without hits nothing is written. The condition's text
    is kept for display.
    """
    identity = F.lit(_identity(condition, mode, limit))
    keys = search(logs, condition, mode, limit).select(
        identity.alias("identity"),
        F.lit(as_condition(condition).key()).alias("condition"),
        "row_key",
        F.xxhash64(identity).alias("identity_hash"),
    )
    writer = keys.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("identity_hash").parquet(path)


def saved_keys(logs: DataFrame, condition: Condition, path: str, limit: int = 100, mode: Mode = "substring") -> DataFrame:
    """The keys saved for a condition, mode and limit, from their one partition."""
    identity = F.lit(_identity(condition, mode, limit))
    saved = logs.sparkSession.read.schema(SAVED).parquet(path)
    mine = saved.where((F.col("identity_hash") == F.xxhash64(identity)) & (F.col("identity") == identity))
    return mine.select("row_key")


def load_result(logs: DataFrame, condition: Condition, path: str, limit: int = 100, mode: Mode = "substring") -> DataFrame:
    """The saved hits with the cells they have now, in key order; rows deleted since are gone.

    The range of the saved keys in each salt, at most 16 rows, is tested at the scan.
    """
    keys = saved_keys(logs, condition, path, limit, mode).withColumn("salt", salt_of_key("row_key"))
    spans = keys.groupBy("salt").agg(F.min("row_key").alias("low"), F.max("row_key").alias("high")).collect()
    inside = [(F.col("salt") == r["salt"]) & F.col("row_key").between(r["low"], r["high"]) for r in spans]
    near = logs.where(reduce(or_, inside) if inside else F.lit(False))
    return near.join(keys, ["salt", "row_key"]).select(*logs.columns).orderBy("row_key")


def search_saved(logs: DataFrame, condition: Condition, path: str, limit: int = 100, mode: Mode = "substring") -> DataFrame:
    """The saved result of a condition, mode and limit, searched and saved first where there is none."""
    try:
        missing = saved_keys(logs, condition, path, limit, mode).isEmpty()
    except AnalysisException:  # nothing was ever saved under the path
        missing = True
    if missing:
        save_result(logs, condition, path, limit, mode)
    try:
        return load_result(logs, condition, path, limit, mode)
    except AnalysisException:  # no hits, and no other result under the path
        return logs.limit(0)
