"""Nearest neighbours by multiprobe p-stable hashing.

Each table cuts several random Gaussian projections into slots of equal width; a bucket is one slot of each. A query
looks into its own bucket and into perturbed ones, in the order in which they are expected to hold neighbours: the
order is worked out once for sorted distances to slot borders and then laid over each query's own distances. Buckets
are read block by block next to the queries that probe them, where candidates are ranked by their exact inner product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.sources.scratch import written


def probe_order(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """The ``probes`` best sets of places among the 2 x hashes border distances in rising order, the empty set first.

    A set's cost is the sum of the expected squares of its distances; it may not move one projection both ways.
    """
    n = 2 * hashes
    rising = [j * (j + 1) / (4 * (hashes + 1) * (hashes + 2)) for j in range(1, hashes + 1)]
    falling = [1 - (n + 1 - j) / (hashes + 1) + (n + 1 - j) * (n + 2 - j) / (4 * (hashes + 1) * (hashes + 2)) for j in range(hashes + 1, n + 1)]
    cost = rising + falling
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if not any(n - 1 - i in chosen for i in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    return out


class Hashing:
    """Projections of all tables; vectors get one more coordinate that makes them equally long, queries a zero there.

    With vectors divided by the largest norm and filled up to length 1, the largest inner product with a query is the
    smallest distance from it.
    """

    def __init__(self, dimension: int, largest: float, tables: int, hashes: int, width: float, probes: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.largest, self.tables, self.hashes, self.width = largest, tables, hashes, width
        self.axes = draw.standard_normal((tables, dimension + 1, hashes))
        self.shift = draw.uniform(0, width, (tables, hashes))
        self.factors = draw.integers(1, 1 << 61, hashes) * 2 + 1
        self.order = probe_order(hashes, probes)

    def _slots(self, rows: np.ndarray, filled: np.ndarray, table: int) -> np.ndarray:
        return (np.hstack([rows, filled[:, None]]) @ self.axes[table] + self.shift[table]) / self.width

    def _key(self, slots: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (slots.astype(np.int64) * self.factors).sum(axis=-1)

    def buckets(self, rows: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket of each vector in each table."""
        scaled = rows / self.largest
        filled = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))
        return np.stack([self._key(np.floor(self._slots(scaled, filled, t))) for t in range(self.tables)], axis=1)

    def probed(self, rows: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) buckets that each query looks into."""
        unit = rows / np.sqrt((rows**2).sum(axis=1))[:, None]
        moves = np.zeros((len(self.order), 2 * self.hashes), dtype=np.int64)
        for p, chosen in enumerate(self.order):
            moves[p, list(chosen)] = 1
        out = []
        for t in range(self.tables):
            at = self._slots(unit, np.zeros(len(unit)), t)
            own = np.floor(at)
            ranked = np.argsort(np.hstack([at - own, 1 - (at - own)]), axis=1, kind="stable")
            placed = np.zeros((len(rows), len(self.order), 2 * self.hashes), dtype=np.int64)
            np.put_along_axis(placed, np.broadcast_to(ranked[:, None, :], placed.shape).copy(), np.broadcast_to(moves, placed.shape), axis=2)
            out.append(self._key(own[:, None, :].astype(np.int64) - placed[:, :, : self.hashes] + placed[:, :, self.hashes :]))
        return np.stack(out, axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(queries: pa.Table, rows: pa.Table, k: int, step: int = 256) -> pa.Table:
    """For each query the k rows of the largest inner product, ties to the smaller id, without the query's own row."""
    if not len(queries) or not len(rows):
        return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    ids, at = rows.column("id").to_numpy(), queries.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], _matrix(rows.column("vector"))[order]
    q = _matrix(queries.column("vector"))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(q), step):
        scores = q[a : a + step] @ x.T
        scores[at[a : a + step, None] == ids[None, :]] = -np.inf
        least = np.partition(scores, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k)]
        for i, limit in enumerate(least):
            hit = np.flatnonzero((scores[i] >= limit - 1e-9 * max(1.0, abs(limit)) if np.isfinite(limit) else np.isfinite(scores[i])) & np.isfinite(scores[i]))
            exact = (x[hit] * q[a + i]).sum(axis=1)
            best = np.lexsort((ids[hit], -exact))[:k]
            out.append((np.full(len(best), at[a + i]), ids[hit][best], exact[best]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 8, hashes: int = 4, width: float = 1.5, probes: int = 16, block: int = 4_000, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of all rows for each row that ``is_query`` (a condition on ``vectors``) names.

    Returns (query_id, rank from 1, vec_id, score) by largest inner product in double precision, ties to the smaller
    id. Rows with a null id, and vectors that are null, zero, of another length than most, or hold a null or a
    non-finite number take no part. Of repeated ids one row's score counts, the largest; a query's own id is no
    candidate. Buckets of more than ``block`` rows are split by id, and their queries go to every part. A query that
    finds fewer than k in its probes is compared with the rest of the rows too.
    """
    usable = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    number = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{number}>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    clean = clean.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(usable)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    lengths = clean.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows"), F.max(norm).alias("largest")).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], result)
    most = max(lengths, key=lambda r: (r["rows"], -r["n"]))
    hashing = Hashing(most["n"], most["largest"], tables, hashes, width, probes, seed)
    rows = clean.filter(F.size("vector") == most["n"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(hashing.buckets(_matrix(batch.column(1)))), pa.list_(pa.int64())), batch.column(1)], ["id", "buckets", "vector"])

    def probes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = hashing.probed(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[sorted(set(p)) for p in row.tolist()] for row in found], pa.list_(pa.list_(pa.int64()))), batch.column(1)], ["id", "buckets", "vector"])

    kind = f"vector array<{number}>"
    index = rows.select("id", "vector").mapInArrow(cells, f"id long, buckets array<long>, {kind}").select("id", "vector", F.posexplode("buckets").alias("table", "bucket"))
    queries = rows.filter("query").select("id", "vector")
    probing = queries.mapInArrow(probes_of, f"id long, buckets array<array<long>>, {kind}").select("id", "vector", F.posexplode("buckets").alias("table", "buckets"))
    probing = probing.select("id", "vector", "table", F.explode("buckets").alias("bucket"))
    large = written(index.groupBy("table", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).filter("parts > 1"), "neighbour-buckets")
    parts = F.coalesce("parts", F.lit(1))
    index = index.join(large, ["table", "bucket"], "left").select("table", "bucket", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "vector")

    def ranked(asked: DataFrame, held: DataFrame) -> DataFrame:
        key = ["table", "bucket", "part"]
        spread = asked.join(large, ["table", "bucket"], "left").select("table", "bucket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "id", "vector")
        near = spread.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(lambda q, x: _nearest(q, x, k), "query_id long, vec_id long, score double")
        return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def first(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    nearest = written(first(ranked(probing, index)), "neighbours")
    enough = nearest.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = written(queries.join(enough, "id", "left_anti"), "neighbour-short")
    if short.isEmpty():
        return nearest
    one = index.filter("table = 0")
    places = [r["bucket"] for r in one.select("bucket").distinct().collect()]
    asked = short.select("id", "vector", F.lit(0).alias("table"), F.explode(F.split(F.lit(" ".join(map(str, places))), " ").cast("array<long>")).alias("bucket"))
    return nearest.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(first(ranked(asked, one)))
