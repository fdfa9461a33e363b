"""Operators: each takes DataFrames and gives a DataFrame; nothing runs until the result is used."""

from clicktrail.operators.charts import first_n, top_n_with_other, with_share
from clicktrail.operators.conditions import SearchCondition
from clicktrail.operators.lines import clicks, load_stats, parse_lines, rejects
from clicktrail.operators.lookup import get_by_key, get_by_keys, scan_time_range, search_by_key_parts
from clicktrail.operators.merge import latest, upsert
from clicktrail.operators.search import (
    hits,
    page,
    page_after,
    page_info,
    search,
    search_count,
    search_summary,
    to_result,
)
from clicktrail.operators.stats import (
    click_order_distribution,
    domain_share,
    facet_counts,
    in_window,
    rank_distribution,
    summary_report,
    top_domains,
    top_queries,
    total_searches,
    user_frequency,
)
from clicktrail.operators.tasks import incomplete_tasks, parse_task_log, recent_operations, task_info

__all__ = [
    "SearchCondition",
    "click_order_distribution",
    "clicks",
    "domain_share",
    "facet_counts",
    "first_n",
    "get_by_key",
    "get_by_keys",
    "hits",
    "in_window",
    "incomplete_tasks",
    "latest",
    "load_stats",
    "page",
    "page_after",
    "page_info",
    "parse_lines",
    "parse_task_log",
    "rank_distribution",
    "recent_operations",
    "rejects",
    "scan_time_range",
    "search",
    "search_by_key_parts",
    "search_count",
    "search_summary",
    "summary_report",
    "task_info",
    "to_result",
    "top_domains",
    "top_n_with_other",
    "top_queries",
    "total_searches",
    "upsert",
    "user_frequency",
    "with_share",
]
