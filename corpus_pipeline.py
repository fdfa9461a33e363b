"""From raw documents to packed training sequences.

Each stage takes the documents that the one before kept and returns those that it keeps, with the columns of
``documents``; the last returns the packed pieces. Stages are written as Parquet in between.

A null text counts as an empty one and stays null. Texts of any length are taken whole. Rows that stand twice get the same
decision; of these, the near-duplicate stage keeps one. An empty table gives an empty one, and a classifier without examples
of both labels keeps all rows. Further columns, whatever their names, are passed on by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.llm import jaccard, packing, quality, secrets, toxicity
from clicktrail.llm.memory import give_back
from clicktrail.llm.queries import QUALITY_CUT, TOKENIZER, UNIFORM, held_out, importable, table
from clicktrail.sources.scratch import written

TOXIC_CUT = 0.5
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
"""Rows and bytes that go to a Python worker at a time. Spark's own 10,000 rows or 64 MB are held on both sides, for each task."""


def prepare(spark: SparkSession) -> None:
    """Workers find the package, and get whole documents in small batches (settings of the session; results are the same).

    What the stage before has freed in the driver's Python, such as its model, goes back to the system.
    """
    give_back()
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that rank below the cut go."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out()), cut_score=QUALITY_CUT)
    return quality.keep(docs, model, QUALITY_CUT)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their nearest examples call toxic go."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.keep(docs, model, TOXIC_CUT)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.75 or more, the one with the smallest id stays."""
    prepare(spark)
    return jaccard.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows the text."""
    prepare(spark)
    clean = secrets.redact(docs, secrets.train(secrets.labelled_samples(docs), uniform=UNIFORM))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, **TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None
"""Trained scores, tokens and packing can't be said in SQL; a test compares the stages with plain Python."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
