"""Folders for intermediate tables, where all executors and the driver can see them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one beside the session's warehouse.

    The warehouse may be a folder of the driver's machine only, so on a cluster the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-scratch").rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the scratch folder."""
    return f"{scratch_folder(spark)}/clicktrail-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written as Parquet and read again, so that later jobs and lost executors don't compute them anew."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
