"""Task parameters, written ``name=value,name=value``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clicktrail.functions.text import CONTROL_AND_BLANK, as_column


def params_to_map(value: Column | str) -> Column:
    """Parameter text to MAP<STRING, STRING>.

    Items without ``=`` are dropped, both sides are trimmed, the value runs to the end of its item and
    the last of equal names wins. Null or empty text gives an empty map.
    """
    items = F.filter(F.split(F.coalesce(as_column(value), F.lit("")), ","), lambda i: F.contains(i, F.lit("=")))
    pairs = F.transform(
        items,
        lambda i: F.struct(
            F.btrim(F.substring_index(i, "=", 1), F.lit(CONTROL_AND_BLANK)).alias("name"),
            F.btrim(F.substr(i, F.instr(i, "=") + 1), F.lit(CONTROL_AND_BLANK)).alias("value"),
        ),
    )
    # Going through an array of one gives the pairs a name, so they are computed once.
    return F.get(F.transform(F.array(pairs), _to_map), F.lit(0))


def _to_map(pairs: Column) -> Column:
    names = F.array_distinct(pairs["name"])

    def last(name: Column) -> Column:
        return F.element_at(F.filter(pairs, lambda p: p["name"] == name), -1)["value"]

    return F.when(F.size(names) == F.size(pairs), F.map_from_arrays(pairs["name"], pairs["value"])).otherwise(
        F.map_from_arrays(names, F.transform(names, last))
    )
