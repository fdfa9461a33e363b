"""Row keys: ``<salt>|<reversed time>#<user>#<domain>``.

The salt spreads users over 16 buckets; within a bucket the newest click sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clicktrail.functions.text import as_column
from clicktrail.functions.times import reverse_ts
from clicktrail.schema import SALT_BUCKETS

_WORD = 0xFFFFFFFF


def _mix(h: Column, unit: Column) -> Column:
    return (h * 31 + unit).bitwiseAND(F.lit(_WORD))


def java_hash(value: Column | str) -> Column:
    """The 31-polynomial string hash over UTF-16 code units, as a signed 32-bit value in BIGINT.

    ``split`` by the empty pattern yields characters; one beyond U+FFFF counts as its two surrogates.
    """

    def step(h: Column, point: Column) -> Column:
        beyond = point - 0x10000
        high = F.shiftright(beyond, 10) + 0xD800
        low = beyond.bitwiseAND(F.lit(0x3FF).cast("bigint")) + 0xDC00
        return F.when(point < 0x10000, _mix(h, point)).otherwise(_mix(_mix(h, high), low))

    def signed(h: Column) -> Column:
        return F.when(h > 0x7FFFFFFF, h - (_WORD + 1)).otherwise(h)

    points = F.transform(F.split(as_column(value), ""), lambda char: F.ascii(char).cast("bigint"))
    return F.aggregate(points, F.lit(0).cast("bigint"), step, signed)


def salt(user_id: Column | str) -> Column:
    """Bucket of a user, 0 to 15."""
    return F.abs(java_hash(user_id) % SALT_BUCKETS).cast("int")


def salt_of(user_id: str) -> int:
    """Bucket of one user given as a literal, for partition pruning."""
    units = memoryview(user_id.encode("utf-16-be")).cast("B")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * 31 + units[i] * 256 + units[i + 1]) & _WORD
    magnitude = h if h <= 0x7FFFFFFF else _WORD + 1 - h
    return magnitude % SALT_BUCKETS


def row_key(salt: Column | str, ts_ms: Column | str, user_id: Column | str, domain: Column | str) -> Column:
    return F.concat(
        F.lpad(as_column(salt).cast("string"), 2, "0"),
        F.lit("|"),
        reverse_ts(ts_ms),
        F.lit("#"),
        as_column(user_id),
        F.lit("#"),
        as_column(domain),
    )


def salt_of_key(key: Column | str) -> Column:
    """Bucket that a row key names, null where the text does not start with two digits."""
    return F.substring(as_column(key), 1, 2).try_cast("int")
