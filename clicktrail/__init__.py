"""Search-log analytics on Spark: load, search and count web-search click logs."""

from clicktrail import functions, operators, plans, sources
from clicktrail.operators import SearchCondition

__all__ = ["SearchCondition", "functions", "operators", "plans", "sources"]
