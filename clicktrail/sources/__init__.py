"""Reading and writing: raw log files, the stored click table, documents, task logs."""

from clicktrail.sources.raw_text import read_raw
from clicktrail.sources.tables import (
    append_documents,
    clear_table,
    compact_table,
    create_table,
    drop_replaced,
    drop_table,
    loads,
    read_logs,
    register,
    table_logs,
    to_documents,
    upsert_table,
    write_logs,
)
from clicktrail.sources.task_log import read_task_log

__all__ = [
    "append_documents",
    "clear_table",
    "compact_table",
    "create_table",
    "drop_replaced",
    "drop_table",
    "loads",
    "read_logs",
    "read_raw",
    "read_task_log",
    "register",
    "table_logs",
    "to_documents",
    "upsert_table",
    "write_logs",
]
