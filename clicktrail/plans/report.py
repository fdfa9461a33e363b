"""The traffic report: every statistic over one window."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.operators.stats import (
    click_order_distribution,
    domain_share,
    facet_counts,
    first_by_count,
    head_facet,
    head_of_facets,
    in_window,
    rank_distribution,
    share_of_head,
    summary_of_head,
    summary_report,
    top_domains,
    top_queries,
    total_of_head,
    total_searches,
    user_frequency,
)


class TrafficReport(Mapping[str, DataFrame]):
    """Parts of a report by name. Leave the ``with`` block, or call ``close``, to free what it keeps."""

    def __init__(self, kept: DataFrame, parts: dict[str, DataFrame]):
        self._kept = kept
        self._parts = parts

    def __getitem__(self, name: str) -> DataFrame:
        return self._parts[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)

    def __enter__(self) -> TrafficReport:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self._kept.unpersist()


def traffic_report(
    logs: DataFrame, start: str = "00:00:00", end: str = "23:59:59", k: int = 100, keep: bool = True
) -> TrafficReport:
    """All statistics of a window.

    The stored clicks are scanned and shuffled once, for the counts per value of all five facets. Only what the parts
    show is kept: the ``k`` largest of three facets, the two distributions and the sums, however many users there are.
    With ``keep`` false nothing is kept and every part is the single statistic, for a caller who wants one of them.
    """
    window = in_window(logs, start, end)
    if not keep:
        return TrafficReport(window, _single_parts(window, start, end, k))
    head = head_of_facets(facet_counts(window), k).persist(StorageLevel.MEMORY_AND_DISK)

    def top(key: str, name: str) -> DataFrame:
        return first_by_count(head_facet(head, key, name), key, name, k)

    ranks = head_facet(head, "rank", "visit_count")
    parts = {
        "total_searches": total_of_head(head),
        "query_statistics": top("query", "search_count"),
        "domain_statistics": top("domain", "visit_count"),
        "user_frequency": top("user_id", "search_count"),
        "rank_statistics": ranks.orderBy("rank"),
        "top10_rank_statistics": ranks.where(F.col("rank") <= 10).orderBy("rank"),
        "click_order_statistics": head_facet(head, "click_order", "count").orderBy("click_order"),
        "domain_distribution": share_of_head(head, "domain", "count", k),
        "summary_report": summary_of_head(head, start, end),
    }
    return TrafficReport(head, parts)


def _single_parts(window: DataFrame, start: str, end: str, k: int) -> dict[str, DataFrame]:
    return {
        "total_searches": total_searches(window),
        "query_statistics": top_queries(window, k),
        "domain_statistics": top_domains(window, k),
        "user_frequency": user_frequency(window, k),
        "rank_statistics": rank_distribution(window),
        "top10_rank_statistics": rank_distribution(window, 10),
        "click_order_statistics": click_order_distribution(window),
        "domain_distribution": domain_share(window, k),
        "summary_report": summary_report(window, start, end),
    }


# The parts that are written to files; the others are shown only.
FILES = (
    "query_statistics",
    "domain_statistics",
    "user_frequency",
    "rank_statistics",
    "click_order_statistics",
    "domain_distribution",
    "summary_report",
)


def write_report(results: Mapping[str, DataFrame], out: str, run_id: str | None = None) -> str:
    """Write each result as CSV without header under ``<out>/<run id>/<name>``; returns that folder.

    A result cut to its k largest rows is one partition, and so one file. Distributions have a row per distinct number
    and are sorted: one file where small, more in order where not.
    """
    folder = f"{out.rstrip('/')}/{run_id or datetime.now().strftime('%Y%m%d_%H%M%S')}"
    for name in FILES:
        if name in results:
            results[name].write.mode("overwrite").csv(f"{folder}/{name}")
    return folder


def first_rows(df: DataFrame, n: int = 10) -> DataFrame:
    """The rows that a preview shows, in the order of ``df``."""
    return df.limit(n)


def preview(df: DataFrame, n: int = 10) -> None:
    """Print the first rows."""
    first_rows(df, n).show(n, truncate=False)
