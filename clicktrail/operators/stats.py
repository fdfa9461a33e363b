"""Traffic statistics over a window of clicks.

Counts are combined before the shuffle, so a key that holds a large share of all clicks sends one row
per task. Every top-k sorts by count, then by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.functions.times import bound_to_ms, clock_bound, in_time_window, is_clock_time
from clicktrail.schema import DAY_MS

TOP = 20


def in_window(logs: DataFrame, start: str, end: str) -> DataFrame:
    """Clicks whose stored time is a strict clock time within [start, end].

    A strict time and its ``ts_ms`` say the same, so the range test is on ``ts_ms``: it reaches the scan,
    where footers rule out row groups, and the text is only looked at for the rows left. 24:00:00 is midnight.
    """
    low, high = clock_bound(start), clock_bound(end)
    if low is None or high is None:
        return logs.where(F.lit(False))
    if "ts_ms" not in logs.columns:
        return logs.where(in_time_window("access_time", low, high))
    inside = F.col("ts_ms").between(bound_to_ms(low), bound_to_ms(high))
    if low == "00:00:00":
        inside = inside | (F.col("ts_ms") == DAY_MS)
    return logs.where(inside & is_clock_time("access_time"))


def _counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def first_by_count(counted: DataFrame, key: str, name: str, k: int) -> DataFrame:
    return counted.orderBy(F.desc(name), F.asc(key)).limit(k)


def total_searches(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_searches"))


def top_queries(df: DataFrame, k: int = TOP) -> DataFrame:
    return first_by_count(_counts(df, "query", "search_count"), "query", "search_count", k)


def top_domains(df: DataFrame, k: int = TOP) -> DataFrame:
    return first_by_count(_counts(df, "domain", "visit_count"), "domain", "visit_count", k)


def user_frequency(df: DataFrame, k: int = TOP) -> DataFrame:
    return first_by_count(_counts(df, "user_id", "search_count"), "user_id", "search_count", k)


def rank_distribution(df: DataFrame, max_rank: int | None = None) -> DataFrame:
    """Visits per rank, in rank order; with ``max_rank`` only up to it, without a lower bound."""
    ranked = df if max_rank is None else df.where(F.col("rank") <= max_rank)
    return _counts(ranked, "rank", "visit_count").orderBy("rank")


def click_order_distribution(df: DataFrame) -> DataFrame:
    return _counts(df, "click_order", "count").orderBy("click_order")


def percent(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, rounded half up in integers, so it never depends on the engine."""
    hundredths = F.call_function("div", part * 20000 + whole, whole * 2)
    return hundredths.cast("double") / 100


def share_of_counts(counted: DataFrame, key: str, name: str, k: int) -> DataFrame:
    """Add to the ``k`` largest counts their percentage of the sum of all counts."""
    whole = counted.agg(F.sum(name)).scalar()
    return first_by_count(counted, key, name, k).withColumn("percentage", percent(F.col(name), whole))


def domain_share(df: DataFrame, k: int = 100) -> DataFrame:
    """Count and percent of the whole window of the ``k`` largest domains."""
    return share_of_counts(_counts(df, "domain", "count"), "domain", "count", k)


def summary_report(df: DataFrame, start: str, end: str, approx: bool = False) -> DataFrame:
    """One row over a window cut before: its bounds, all searches, distinct users, queries, domains.

    ``approx`` estimates the distinct counts from sketches, which shuffles a few kilobytes per task.
    """
    bounds = (F.lit(start).alias("start_time"), F.lit(end).alias("end_time"))
    names = {"unique_users": "user_id", "unique_queries": "query", "unique_domains": "domain"}
    if approx:
        distinct = [F.approx_count_distinct(c).cast("bigint").alias(n) for n, c in names.items()]
        return df.agg(F.count("*").alias("total_searches"), *distinct).select(*bounds, "total_searches", *names)
    return summary_of_facets(facet_counts(df, tuple(names.values())), start, end)


FACETS = ("query", "domain", "user_id", "rank", "click_order")


def facet_counts(df: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """Counts per value of each facet in one pass: (facet, <facets...>, n), one facet filled per row.

    All statistics derive from this table, which has as many rows as there are distinct values.
    """
    last = len(facets) - 1
    everything = 2 ** len(facets) - 1
    # grouping_id has a bit per column that a row is not grouped by; the first column is the highest bit.
    facet_of = F.coalesce(*(F.when(F.col("gid") == everything - 2 ** (last - i), f) for i, f in enumerate(facets)))
    counted = df.groupingSets([[F.col(f)] for f in facets], *facets).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n")
    )
    return counted.select(facet_of.alias("facet"), *facets, "n")


def facet(counts: DataFrame, key: str, name: str) -> DataFrame:
    """The counts of one facet as (key, name)."""
    return counts.where(F.col("facet") == key).select(key, F.col("n").alias(name))


def head_of_facets(counts: DataFrame, k: int, whole: tuple[str, ...] = ("rank", "click_order")) -> DataFrame:
    """What a report needs of the counts: (facet, <facets...>, n, values), with the counts grouped once.

    The ``k`` largest counts of each facet, all counts of the facets in ``whole``, and for each facet a row with
    ``values``, the number of its values, and their sum as n. Apart from ``whole`` its size doesn't depend on the data.
    """
    facets = [c for c in counts.columns if c not in ("facet", "n")]
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), *(f for f in facets if f not in whole)))
    none = F.lit(None).cast("bigint").alias("values")
    largest = counts.where(~F.col("facet").isin(*whole)).withColumn("place", place).where(F.col("place") <= k)
    sums = counts.groupBy("facet").agg(F.sum("n").alias("n"), F.count(F.coalesce(*(F.col(f).cast("string") for f in facets))).alias("values"))
    empty = (F.lit(None).cast(counts.schema[f].dataType).alias(f) for f in facets)
    columns = ["facet", *facets, "n"]
    return (
        largest.select(*columns, none)
        .unionByName(counts.where(F.col("facet").isin(*whole)).select(*columns, none))
        .unionByName(sums.select("facet", *empty, "n", "values"))
    )


def _sum_of(facet: str) -> Column:
    return F.max(F.when((F.col("facet") == facet) & F.col("values").isNotNull(), F.col("n")))


def total_of_head(head: DataFrame) -> DataFrame:
    """All searches: every facet adds up to them."""
    return head.agg(F.coalesce(_sum_of("domain"), F.lit(0).cast("bigint")).alias("total_searches"))


def summary_of_head(head: DataFrame, start: str, end: str) -> DataFrame:
    names = {"unique_users": "user_id", "unique_queries": "query", "unique_domains": "domain"}
    values = (F.coalesce(F.max(F.when(F.col("facet") == f, F.col("values"))), F.lit(0).cast("bigint")).alias(n) for n, f in names.items())
    total = F.coalesce(_sum_of("domain"), F.lit(0).cast("bigint")).alias("total_searches")
    return head.agg(total, *values).select(F.lit(start).alias("start_time"), F.lit(end).alias("end_time"), "*")


def share_of_head(head: DataFrame, key: str, name: str, k: int) -> DataFrame:
    """The ``k`` largest counts of a facet with their percentage of its sum."""
    whole = head.agg(_sum_of(key)).scalar()
    return first_by_count(head_facet(head, key, name), key, name, k).withColumn("percentage", percent(F.col(name), whole))


def head_facet(head: DataFrame, key: str, name: str) -> DataFrame:
    return facet(head.where(F.col("values").isNull()), key, name)


def _total() -> Column:
    # Every facet adds up to all searches; domain has few rows.
    of_domains = F.sum(F.when(F.col("facet") == "domain", F.col("n")))
    return F.coalesce(of_domains, F.lit(0).cast("bigint")).alias("total_searches")


def summary_of_facets(counts: DataFrame, start: str, end: str) -> DataFrame:
    def distinct(key: str) -> Column:
        return F.count(F.when(F.col("facet") == key, F.col(key)))

    return counts.agg(
        _total(),
        distinct("user_id").alias("unique_users"),
        distinct("query").alias("unique_queries"),
        distinct("domain").alias("unique_domains"),
    ).select(F.lit(start).alias("start_time"), F.lit(end).alias("end_time"), "*")
