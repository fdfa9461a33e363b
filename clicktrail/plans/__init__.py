"""Whole jobs made of the operators: loading, reporting, saved searches."""

from clicktrail.plans.load import LoadResult, load_documents, load_files, parsed_files
from clicktrail.plans.report import TrafficReport, first_rows, preview, traffic_report, write_report
from clicktrail.plans.saved import load_result, save_result, search_saved

__all__ = [
    "LoadResult",
    "TrafficReport",
    "first_rows",
    "load_documents",
    "load_files",
    "load_result",
    "parsed_files",
    "preview",
    "save_result",
    "search_saved",
    "traffic_report",
    "write_report",
]
