"""Loading log files: read, parse, quarantine, upsert."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clicktrail.operators.lines import clicks, parse_lines, rejects
from clicktrail.schema import REASONS
from clicktrail.sources.raw_text import read_raw
from clicktrail.sources.tables import BYTES_PER_FILE, append_documents, partitions_for, to_documents, upsert_table


@dataclass(frozen=True)
class LoadResult:
    """What a load did: lines that were not blank, good ones, and bad ones by reason."""

    load: str
    lines: int
    parsed: int
    rejected: dict[str, int] = field(default_factory=dict)


def parsed_files(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    return parse_lines(read_raw(spark, path, encoding))


def load_files(
    spark: SparkSession,
    path: str | list[str],
    table: str,
    rejects_path: str | None = None,
    encoding: str = "UTF-8",
    bytes_per_file: int = BYTES_PER_FILE,
) -> LoadResult:
    """Add log files to a catalog table as one load, and write the bad lines under ``rejects_path``.

    Counters are observed while the clicks are written. Bad lines go to a partition named for the files and the
    charset, so that loading the same files again replaces them; only where there are any are the files parsed a
    second time, which is cheap beside keeping every parsed row.
    """
    parsed = parsed_files(spark, path, encoding)
    seen = Observation()
    counts = {r: F.count_if(F.col("reason") == r).alias(r) for r in REASONS}
    counted = parsed.observe(seen, F.count("*").alias("lines"), F.count_if(F.col("reason").isNull()).alias("parsed"), *counts.values())
    load = upsert_table(spark, table, clicks(counted), partitions=partitions_for(spark, path, bytes_per_file))
    met = seen.get
    bad = {r: met[r] for r in REASONS if met[r]}
    if rejects_path is not None:
        files = json.dumps([sorted([path] if isinstance(path, str) else path), encoding])
        source = hashlib.sha256(files.encode()).hexdigest()[:16]
        rows = rejects(parsed) if bad else rejects(parsed).limit(0)
        out = rows.withColumn("source", F.lit(source)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy("source").parquet(rejects_path)
    return LoadResult(load, met["lines"], met["parsed"], bad)


def load_documents(
    spark: SparkSession, path: str | list[str], out: str, format: str = "json", encoding: str = "UTF-8"
) -> None:
    """Append the good lines of log files as documents, one per line."""
    append_documents(to_documents(clicks(parsed_files(spark, path, encoding))), out, format)
