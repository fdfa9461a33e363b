"""Column functions, all composed of built-in expressions."""

from clicktrail.functions.keys import java_hash, row_key, salt, salt_of, salt_of_key
from clicktrail.functions.params import params_to_map
from clicktrail.functions.text import trim_control
from clicktrail.functions.times import in_time_window, normalize_time, reverse_ts, time_to_ms
from clicktrail.functions.urls import extract_domain

__all__ = [
    "extract_domain",
    "in_time_window",
    "java_hash",
    "normalize_time",
    "params_to_map",
    "reverse_ts",
    "row_key",
    "salt",
    "salt_of",
    "salt_of_key",
    "time_to_ms",
    "trim_control",
]
