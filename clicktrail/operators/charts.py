"""Data behind the charts of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the label of the slice that holds the remaining rows.
OTHER = "其他"


def top_n_with_other(
    counted: DataFrame, key: str, value: str, n: int = 8, cap: int | None = None, other: str = OTHER
) -> DataFrame:
    """The ``n`` largest rows and one more for the sum of the rest, as (key, value, is_other).

    The rest is all other rows; with a ``cap`` it ends at that row, as where only the head of a list is at hand.
    The extra row is left out when it would be zero. It is a difference of two sums, so nothing but the sums is brought together.
    """
    order = (F.desc(value), F.asc(key))
    considered = counted if cap is None else counted.orderBy(*order).limit(cap)
    top = counted.orderBy(*order).limit(n if cap is None else min(n, cap))
    rest = considered.agg(F.sum(value).alias("total")).select(
        F.lit(other).alias(key),
        (F.col("total") - top.agg(F.sum(value)).scalar()).alias(value),
        F.lit(True).alias("is_other"),
    )
    shown = top.select(F.col(key).cast("string").alias(key), value, F.lit(False).alias("is_other"))
    return shown.unionByName(rest.where(F.col(value) > 0))


def first_n(counted: DataFrame, key: str, n: int = 8) -> DataFrame:
    """The first ``n`` categories in key order."""
    return counted.orderBy(key).limit(n)


def with_share(charted: DataFrame, value: str) -> DataFrame:
    """Add the share of each charted row in their sum."""
    return charted.withColumn("share", F.col(value) / charted.agg(F.sum(value)).scalar())
