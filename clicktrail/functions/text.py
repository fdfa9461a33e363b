"""String helpers shared by the column functions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character up to and including the blank.
CONTROL_AND_BLANK = "".join(map(chr, range(0x21)))


# Every decimal digit of one UTF-16 unit beyond ASCII, and its value.
OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd")
THEIR_VALUES = "".join(str(unicodedata.decimal(c)) for c in OTHER_DIGITS)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_control(value: Column | str) -> Column:
    """Strip characters <= U+0020 from both ends.

    ``btrim`` with a 33-character set is slow, and nearly no field needs it: a string compare with
    ``'!'`` (U+0021) tells whether the first or the last character does.
    """
    c = as_column(value)
    needed = (c < "!") | (F.substring(c, -1, 1) < "!")
    return F.when(needed, F.btrim(c, F.lit(CONTROL_AND_BLANK))).otherwise(c)


def ascii_digits(value: Column | str) -> Column:
    """Decimal digits of any script as 0 to 9; a cheap test spares all texts without one."""
    c = as_column(value)
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, OTHER_DIGITS, THEIR_VALUES)).otherwise(c)
