"""Raw log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicktrail.sources.settings import settings

_PROBE = "\r\n0\t"


def _encoded(spark: SparkSession, text: str, encoding: str) -> bytes:
    """Bytes of a text by the JVM's charset of that name, the one that decodes the files."""
    with settings(spark, legacy__javaCharsets="true", legacy__codingErrorAction="true"):
        return bytes(spark.range(1).select(F.encode(F.lit(text), encoding)).first()[0])


def _check_line_breaks(spark: SparkSession, encoding: str) -> None:
    """Refuse charsets whose line breaks, tabs or digits are not the single ASCII bytes."""
    if _encoded(spark, _PROBE, encoding) != _PROBE.encode("ascii"):
        raise ValueError(f"{encoding} files cannot be split by line; convert them to UTF-8 first")


def read_raw(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Lines of text files as (line, load_seq).

    ``load_seq`` orders the lines of a load: file path, then split, then place within the split. It
    costs no shuffle and no numbering pass. Files are split and read in parallel whatever the charset:
    lines are cut on raw bytes and decoded afterwards, with broken bytes replaced rather than fatal.
    """
    utf8 = encoding.lower().replace("_", "-") in ("utf-8", "utf8")
    if not utf8:
        _check_line_breaks(spark, encoding)
    lines = spark.read.text(path).select(
        F.col("value"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("load_seq"),
    )
    if utf8:
        return lines.select(F.make_valid_utf8("value").alias("line"), "load_seq")
    # Both settings are taken up when the expression is built.
    with settings(spark, legacy__javaCharsets="true", legacy__codingErrorAction="true"):
        return lines.select(F.decode(F.col("value").cast("binary"), encoding).alias("line"), "load_seq")
