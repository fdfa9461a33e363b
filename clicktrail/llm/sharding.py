"""Sharding by longest-processing-time scheduling.

Rows whose texts are equal form a group that stays together. Groups go by size, largest first, to the shard with
the least load. Groups of one size are interchangeable, so the schedule needs only how many groups each size has:
a bounded table on the driver, while groups and rows are numbered by Spark.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.sources.scratch import written

EXACT_SIZES = 1 << 16
"""Group sizes below this are scheduled as they are; larger ones in classes no wider than 1/4096 of the size."""


def longest_first(sizes: Iterable[tuple[float, int]], shards: int) -> list[list[int]]:
    """How many groups of each size every shard gets, for (size, count) in falling order of size.

    The same as taking the groups one by one from a heap of loads; long runs of one size are filled up to a common
    level first, so that the time follows the number of sizes and not of groups.
    """
    loads = [0.0] * shards
    out = []
    for size, count in sizes:
        got = [0] * shards
        if count > 4 * shards:
            low, high = min(loads), max(loads) + size * (count / shards + 1)
            for _ in range(80):
                level = (low + high) / 2
                if sum(max(0, math.ceil((level - x) / size)) for x in loads) <= count:
                    low = level
                else:
                    high = level
            got = [max(0, math.ceil((low - x) / size)) for x in loads]
        heap = [(x + n * size, s) for s, (x, n) in enumerate(zip(loads, got, strict=True))]
        heapq.heapify(heap)
        for _ in range(count - sum(got)):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            got[s] += 1
        loads = [x + n * size for x, n in zip(loads, got, strict=True)]
        out.append(got)
    return out


def _numbered(df: DataFrame, key: str, order: list[str], buckets: int, name: str) -> DataFrame:
    """Add ``name``, gapless from 0 within each ``key``; a hot key is numbered in ``buckets`` parts, each by its own task."""
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = cut.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    return cut.withColumn("_local", local).join(offsets, [key, "_part"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", buckets: int = 256) -> DataFrame:
    """Put every row into one of ``shards`` shards of near equal bytes; equal texts go to one shard.

    Returns a row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, law (``bytes``), shard, slot (gapless from
    0 within the shard) and grown_shard (null: the law doesn't grow).
    A null text counts as empty. Null and repeated ids are rows like any other. Groups of one size are taken in the
    order of their text's digest, rows of a shard in parts by a hash, then by id; equal rows may swap slots. An empty
    table gives an empty one. One group larger than the mean shard makes its shard larger than the others.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        ),
        "shard-rows",
    )
    step = F.when(F.col("bytes") < EXACT_SIZES, 1).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("bytes")) - 12).cast("long"))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("class", F.col("bytes") - F.col("bytes") % step)
    classes = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).orderBy(F.desc("class")).collect()
    plan = longest_first(((r["total"] / r["n"], r["n"]) for r in classes), shards)
    ends = [[sum(got[: s + 1]) for s in range(shards)] for got in plan]
    table = pa.table({"class": pa.array([r["class"] for r in classes], pa.int64()), "ends": pa.array(ends, pa.list_(pa.int64()))})
    ranked = _numbered(groups, "class", ["digest"], buckets, "rank").join(spark.createDataFrame(table), "class")
    chosen = ranked.select("digest", F.size(F.filter("ends", lambda end: end <= F.col("rank"))).alias("shard"))
    placed = written(rows.join(chosen, "digest").select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    return _numbered(placed, "shard", ["doc_id", "text_crc32", "size"], buckets, "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
