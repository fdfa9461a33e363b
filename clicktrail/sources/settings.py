"""Session settings for the length of a block."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Set ``spark.sql`` settings, given with ``__`` for dots, and put the former values back."""
    wanted = {"spark.sql." + name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
