"""From raw lines to clicks: parse, validate, key, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.functions.keys import row_key, salt
from clicktrail.functions.text import ascii_digits, trim_control
from clicktrail.functions.times import THREE_INTEGERS, ms_of_parts
from clicktrail.functions.urls import extract_domain
from clicktrail.schema import (
    FIELD_COUNT,
    LOG_COLUMNS,
    RANK_CLICK_FORMAT,
    RANK_CLICK_NUMBER,
    REQUIRED_EMPTY,
    TIME_FORMAT,
    TIME_NUMBER,
)

FIELDS = ("access_time", "user_id", "query", "rank_click", "url")
# Fixed value: two integers with whitespace between. Control characters may cling to either number.
TWO_INTEGERS = r"^[+-]?[0-9]+[\x00-\x08\x0E-\x1F]*\s+[\x00-\x08\x0E-\x1F]*[+-]?[0-9]+\z"

_BLANK = "blank"


def _classify(raw: DataFrame) -> DataFrame:
    """Parse every line once; ``reason`` is null for a click and names the fault otherwise.

    Each step is its own projection, so nothing is computed twice. The last one goes through
    ``inline``: the optimizer does not move filters below a generator, where they would repeat the
    whole parse for every test in them (4 times the run time when tried).
    """
    carried = [c for c in raw.columns if c != "line"]
    trimmed = raw.select(*carried, trim_control("line").alias("line"))
    split = trimmed.select(*carried, "line", F.split("line", "\t").alias("parts"))
    fields = split.select(
        *carried,
        "line",
        F.size("parts").alias("n_parts"),
        *(trim_control(F.get("parts", F.lit(i))).alias(name) for i, name in enumerate(FIELDS)),
    )
    # Numbers may be written in the digits of any script; the stored time keeps them.
    digits = fields.select(
        "*", ascii_digits("rank_click").alias("rank_digits"), ascii_digits("access_time").alias("time_digits")
    )
    shaped = digits.select(
        *carried,
        "line",
        "n_parts",
        *FIELDS,
        F.col("rank_digits").rlike(TWO_INTEGERS).alias("two_integers"),
        F.regexp_replace("rank_digits", r"[\x00-\x20]+", " ").alias("numbers"),
        F.col("time_digits").rlike(THREE_INTEGERS).alias("three_integers"),
        F.split("time_digits", ":").alias("time_parts"),
    )
    numbered = shaped.select(
        "*",
        F.when(F.col("two_integers"), F.substring_index("numbers", " ", 1).try_cast("int")).alias("rank"),
        F.when(F.col("two_integers"), F.substring_index("numbers", " ", -1).try_cast("int")).alias("click_order"),
        F.when(F.col("three_integers"), ms_of_parts(F.col("time_parts"))).alias("ts_ms"),
    )
    # The two counts are only taken of lines that failed the pattern.
    two_parts = F.size(F.split("rank_click", r"\s+")) == 2
    three_parts = F.size(F.split(F.rtrim("access_time", F.lit(":")), ":")) == 3
    bad_numbers = F.col("rank").isNull() | F.col("click_order").isNull()
    reason = (
        F.when(F.col("line") == "", _BLANK)
        .when(F.col("n_parts") != 5, FIELD_COUNT)
        .when((F.col("access_time") == "") | (F.col("user_id") == "") | (F.col("url") == ""), REQUIRED_EMPTY)
        .when(bad_numbers & ~F.col("two_integers") & ~two_parts, RANK_CLICK_FORMAT)
        .when(bad_numbers, RANK_CLICK_NUMBER)
        .when(F.col("ts_ms").isNull() & ~F.col("three_integers") & ~three_parts, TIME_FORMAT)
        .when(F.col("ts_ms").isNull(), TIME_NUMBER)
    )
    kept = ("ts_ms", "access_time", "user_id", "query", "rank", "click_order", "url")
    record = F.struct(*carried, "line", reason.alias("reason"), *kept)
    return numbered.select(F.inline(F.array(record)))


def parse_lines(raw: DataFrame) -> DataFrame:
    """Parsed lines with a ``reason`` column; blank lines are skipped.

    ``raw`` has a ``line`` column; its other columns (load order, line number) are carried along.
    """
    return _classify(raw).where(~F.col("reason").eqNullSafe(_BLANK))


def clicks(parsed: DataFrame) -> DataFrame:
    """The good lines, with domain, salt and row key, still one row per line."""
    carried = [c for c in parsed.columns if c not in (*LOG_COLUMNS, "line", "reason")]
    return (
        parsed.where(F.col("reason").isNull())
        .withColumns({"domain": extract_domain("url"), "salt": salt("user_id")})
        .withColumn("row_key", row_key("salt", "ts_ms", "user_id", "domain"))
        .select(*carried, *LOG_COLUMNS)
    )


def rejects(parsed: DataFrame) -> DataFrame:
    """The bad lines with the first fault found."""
    carried = [c for c in parsed.columns if c not in (*LOG_COLUMNS, "line", "reason")]
    return parsed.where(F.col("reason").isNotNull()).select(*carried, "line", "reason")


def load_stats(raw: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Counters of a load as (counter, n).

    ``lines`` counts every line read, ``parsed`` the good ones before equal keys collapse, ``rejected``
    and ``rejected:<reason>`` the bad ones; with ``stored`` also the rows kept. One pass over the lines.
    """
    reason = F.col("reason")
    per_reason = _classify(raw).select("reason").groupBy("reason").agg(F.count("*").alias("n"))
    # Each of the few reasons adds to its own counters.
    bad = reason.isNotNull() & (reason != _BLANK)
    counters = F.array_compact(
        F.array(
            F.lit("lines"),
            F.when(reason.isNull(), "parsed"),
            F.when(bad, "rejected"),
            F.when(bad, F.concat(F.lit("rejected:"), reason)),
        )
    )
    counted = per_reason.select(F.explode(counters).alias("counter"), "n")
    if stored is not None:
        counted = counted.unionByName(
            stored.agg(F.count("*").alias("n")).select(F.lit("stored").alias("counter"), "n")
        )
    return counted.groupBy("counter").agg(F.sum("n").alias("n"))
