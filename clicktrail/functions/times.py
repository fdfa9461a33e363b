"""Time-of-day columns. A time is milliseconds since midnight; there is no date."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clicktrail.functions.text import CONTROL_AND_BLANK, as_column, ascii_digits, trim_control
from clicktrail.schema import DAY_MS, LONG_MAX, LONG_MIN

# Three integers between colons; colons at the end carry nothing. Any size and sign is let through,
# so 25:99:99 is a time.
THREE_INTEGERS = r"^[+-]?[0-9]+:[+-]?[0-9]+:[+-]?[0-9]+:*\z"
# A clock time of HH:mm:ss, blanks around it allowed, with 24:00:00 as another name of midnight.
CLOCK_TIME = r"^[\x00-\x20]*(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]|24:00:00)[\x00-\x20]*\z"

_LOOSE = re.compile(r"([+-]?\d+):([+-]?\d+):([+-]?\d+):*")
_CLOCK = re.compile(CLOCK_TIME.replace(r"\z", r"\Z"))


def ms_of_parts(parts: Column) -> Column:
    """Milliseconds from an array of hour, minute and second texts; null past int32."""
    hours, minutes, seconds = (F.get(parts, F.lit(i)).try_cast("int").cast("bigint") for i in range(3))
    return ((hours * 60 + minutes) * 60 + seconds) * 1000


def time_to_ms(value: Column | str) -> Column:
    """Time text to milliseconds since midnight, null where it is not three int32 parts. Digits may be of any script."""
    c = ascii_digits(trim_control(value))
    return F.when(c.rlike(THREE_INTEGERS), ms_of_parts(F.split(c, ":")))


def reverse_ts(ts_ms: Column | str) -> Column:
    """Largest BIGINT minus the time, 19 digits wide, so that a later time sorts first.

    Times below zero wrap around to a negative number, as 64-bit arithmetic does.
    """
    c = as_column(ts_ms)
    return F.when(c >= 0, F.lpad((F.lit(LONG_MAX) - c).cast("string"), 19, "0")).otherwise(
        (F.lit(LONG_MIN) + (-c - 1)).cast("string")
    )


def bound_to_ms(text: str) -> int:
    """Milliseconds of a time bound given as a literal; raises on anything but three integers."""
    found = _LOOSE.fullmatch(text.strip(CONTROL_AND_BLANK))
    parts = [int(p) for p in found.groups()] if found else []
    if not parts or not all(-(2**31) <= p < 2**31 for p in parts):
        raise ValueError(f"a time must read HH:mm:ss, got {text!r}")
    hours, minutes, seconds = parts
    return ((hours * 60 + minutes) * 60 + seconds) * 1000


def normalize_time(text: str) -> str:
    """A time bound as HH:mm:ss within one day: 25:00:00 becomes 01:00:00."""
    seconds = bound_to_ms(text) % DAY_MS // 1000
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def clock_bound(text: str) -> str | None:
    """A strict HH:mm:ss bound, or None where it is not one."""
    text = text.strip(CONTROL_AND_BLANK)
    if not _CLOCK.match(text):
        return None
    return "00:00:00" if text == "24:00:00" else text


def is_clock_time(value: Column | str) -> Column:
    """True for strict HH:mm:ss texts."""
    return as_column(value).rlike(CLOCK_TIME)


def in_time_window(value: Column | str, start: str, end: str) -> Column:
    """True for strict clock times within [start, end]; false for other texts and bad bounds."""
    low, high = clock_bound(start), clock_bound(end)
    if low is None or high is None:
        return F.lit(False)
    c = trim_control(value)
    inside = c.between(low, high)
    if low == "00:00:00":
        inside = inside | (c == "24:00:00")
    return F.coalesce(is_clock_time(c) & inside, F.lit(False))
