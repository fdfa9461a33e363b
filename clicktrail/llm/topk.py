"""Exact largest inner products by a pivot table.

A further coordinate makes all candidates equally long; queries have a zero there. Then the largest inner product is the
smallest distance, and distances obey the triangle inequality: the distances of query and candidate from any pivot differ
by no more than the two are apart. Every row's distances from many pivots are worked out once and stored. The largest
difference over all pivots bounds a candidate's distance from below; candidates are looked at in the order of that bound
until it is above the k-th distance found, so that nothing that belongs to the result can be left out.

Rows stand in blocks, neighbours of one pivot together. Each query is first held against its own block, which gives it a
radius; then tiles of queries meet the blocks that the blocks' own bounds don't rule out. Blocks and tiles have a fixed
number of rows, so tasks keep their size, whatever the table's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.llm.merkle import placed
from clicktrail.sources.scratch import written

FOUND = "query_id long, vec_id long, score long"
SLACK = 1e-5
"""Room for rounding in stored distances, as a part of the largest."""


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Places of at most ``count`` points, each the farthest from those before; the first is the farthest from the mean."""
    gap = ((points - points.mean(axis=0)) ** 2).sum(axis=1)
    chosen = [int(gap.argmax())]
    gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(rows: np.ndarray, fill: np.ndarray, pivots: np.ndarray, pivot_fill: np.ndarray) -> np.ndarray:
    """(rows, pivots) distances with the further coordinate in ``fill``."""
    square = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(square + (fill[:, None] - pivot_fill) ** 2, 0))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where every partial sum is exact, else in 64-bit integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if bound < 2.0**53:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def nearest(ids: np.ndarray, queries: np.ndarray, query_table: np.ndarray, least: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, row_table: np.ndarray, largest: float, k: int, together: int = 64, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, row ids, scores) of the k largest scores of each query, ties to the smaller id; none below ``least``.

    ``query_table`` and ``row_table`` hold distances from the pivots. ``together`` queries share one order of the
    candidates, by the smallest bound that any of them has, and go through it ``step`` at a time.
    """
    slack = np.float32(SLACK * max(query_table.max(initial=0), row_table.max(initial=0)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    by_pivot = np.ascontiguousarray(row_table.T)
    gap = np.empty((together, len(row_ids)), np.float32)
    for a in range(0, len(ids), together):
        at, q, least_now = ids[a : a + together], queries[a : a + together], least[a : a + together].astype(float)
        length = (q.astype(float) ** 2).sum(axis=1) + largest**2
        bound = np.zeros((len(at), len(row_ids)), np.float32)
        for p, held in enumerate(by_pivot):
            np.subtract(query_table[a : a + together, p, None], held, out=gap[: len(at)])
            np.maximum(bound, np.abs(gap[: len(at)], out=gap[: len(at)]), out=bound)
        smallest = bound.min(axis=0)
        order = np.argsort(smallest, kind="stable")
        who, which, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in range(0, len(order), step):
            # A negative square means that no candidate at all can reach the score.
            radius = np.where(np.isfinite(least_now), np.sqrt(np.maximum(length - 2 * np.where(np.isfinite(least_now), least_now, 0), 0)), np.inf)
            if smallest[order[b]] > radius.max() + slack:
                break
            some = order[b : b + step]
            open_ = np.flatnonzero((bound[:, some] <= (radius + slack)[:, None]).any(axis=1))
            if not len(open_):
                continue
            got = _scores(q[open_], rows[some])
            hit = (got >= least_now[open_, None]) & (row_ids[some][None, :] != at[open_, None])
            i, j = np.nonzero(hit)
            who, which, score = np.append(who, open_[i]), np.append(which, some[j]), np.append(score, got[i, j])
            best = np.lexsort((row_ids[which], -score, who))
            who, which, score = who[best], which[best], score[best]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            kept = place < k
            who, which, score, place = who[kept], which[kept], score[kept], place[kept]
            full = place == k - 1
            least_now[who[full]] = np.maximum(least_now[who[full]], score[full])
        out.append((at[who], row_ids[which], score))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, pivots: int = 32, sample: int = 2_048, block: int = 8_192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest integer inner products of each row that ``is_query`` (a condition on ``vectors``) names, over all rows.

    A component x counts as floor(scale * x), in double precision. Returns (query_id, rank from 1, vec_id, score), ties
    to the smaller id; a query with fewer than k other rows gets them all. A query's own id is no candidate.

    Pivots come from the ``sample`` rows of the smallest id hash; that decides speed, never results. Rows with a null id,
    and vectors that are null, empty, of another length than most (of equally frequent lengths the shorter), or hold a
    null, a non-finite number or one over 2^53 after scaling take no part; a zero vector does. Of an id that repeats, one
    row counts, that of the greatest vector, and it is a query if any of its rows is. Scores over 64 bits wrap around.
    Other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    result = "query_id long, rank int, vec_id long, score long"
    spark = vectors.sparkSession
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**53))
    clean = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable)
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(scale)))
    clean = clean.select(F.col(id_col).cast("long").alias("id"), whole.alias("x"), F.coalesce(is_query, F.lit(False)).alias("query"))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    lengths = clean.filter(F.size("x") > 0).groupBy(F.size("x").alias("length")).agg(F.count("*").alias("rows"), F.max(square).alias("square")).collect()
    if not lengths:
        return spark.createDataFrame([], result)
    most = max(lengths, key=lambda r: (r["rows"], -r["length"]))
    length, largest = most["length"], float(np.sqrt(most["square"]))
    rows = clean.filter(F.size("x") == length).groupBy("id").agg(F.max("x").alias("x"), F.max("query").alias("query"))
    few = clean.filter(F.size("x") == length).orderBy(F.xxhash64("id"), "id", "x").limit(sample).select("x").toArrow()
    points = _matrix(few.column("x"), length).astype(float)
    fills = np.sqrt(np.maximum(largest**2 - (points**2).sum(axis=1), 0))
    chosen = farthest_first(np.hstack([points, fills[:, None]]), pivots)
    pivot, pivot_fill = points[chosen], fills[chosen]
    width = len(chosen)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(1), length).astype(float)
                fill = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
                held, asked = distances(x, fill, pivot, pivot_fill), distances(x, np.zeros(len(x)), pivot, pivot_fill)
                flat = [pa.FixedSizeListArray.from_arrays(pa.array(m.astype(np.float32).ravel()), width).cast(pa.list_(pa.float32())) for m in (held, asked)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.argmin(axis=1).astype(np.int32)), *flat], ["id", "x", "query", "cell", "held", "asked"])

    table = rows.select("id", "x", "query").mapInArrow(measured, "id long, x array<long>, query boolean, cell int, held array<float>, asked array<float>")
    laid = placed(table.withColumn("grp", F.lit("")), "grp", ["cell", "id"], "topk-ranges")
    laid = written(laid.select("id", "x", "query", "held", "asked", F.floor(F.col("pos") / block).alias("block")), "topk-table")
    held = laid.select("block", "id", "x", "held")
    queries = laid.filter("query").select("block", "id", "x", "asked")

    def own(group: pa.Table) -> pa.Table:
        mine = group.filter(group.column("query"))
        return found(mine, np.full(len(mine), -np.inf), group)

    def found(asked: pa.Table, least: np.ndarray, group: pa.Table) -> pa.Table:
        ids = (asked.column("id").to_numpy(), _matrix(asked.column("x"), length), _matrix(asked.column("asked"), width), least)
        q, r, s = nearest(*ids, group.column("id").to_numpy(), _matrix(group.column("x"), length), _matrix(group.column("held"), width), largest, k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(r, pa.int64()), "score": pa.array(s, pa.int64())})

    near = written(laid.groupBy("block").applyInArrow(own, FOUND), "topk-near")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def first(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    last = laid.agg(F.max("block")).first()[0]
    if not last:
        return first(near)
    # What a query has to reach: its k-th score so far, as far as it has so many.
    reached = near.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k)
    asking = placed(queries.withColumn("grp", F.lit("")), "grp", ["block", "id"], "topk-queries")
    asking = asking.join(reached.select(F.col("query_id").alias("id"), F.col("score").alias("least")), "id", "left")
    asking = written(asking.select("id", "x", "asked", "least", F.floor(F.col("pos") / block).alias("tile"), F.col("block").alias("own")), "topk-asking")
    pairs = written(_open_pairs(asking, held, width, largest), "topk-pairs")

    def meet(asked: pa.Table, group: pa.Table) -> pa.Table:
        if not len(asked) or not len(group):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        other = asked.filter(pa.compute.not_equal(asked.column("own"), group.column("block")[0]))
        # ``to_numpy`` turns missing scores into NaN.
        least = other.column("least").cast(pa.float64(), safe=False).to_numpy()
        return found(other, np.where(np.isnan(least), -np.inf, least), group)

    left = pairs.join(asking, "tile").groupBy("tile", "block")
    named = pairs.select(F.col("tile").alias("for_tile"), F.col("block").alias("of"))
    right = named.join(held, F.col("of") == F.col("block")).select("for_tile", "of", "block", "id", "x", "held").groupBy("for_tile", "of")
    far = left.cogroup(right).applyInArrow(meet, FOUND)
    return first(near.unionByName(far))


def _open_pairs(asking: DataFrame, held: DataFrame, width: int, largest: float) -> DataFrame:
    """(tile, block) of which some query may find something in the block, by the ranges of their distances from each pivot."""

    def ranges(rows: DataFrame, key: str, table: str, *more: Column) -> DataFrame:
        ends = [f(F.get(table, F.lit(p))).alias(f"{f.__name__}{p}") for p in range(width) for f in (F.min, F.max)]
        made = rows.groupBy(key).agg(*ends, *more)
        lists = [F.array(*(F.col(f"{f}{p}") for p in range(width))).alias(f"{key}_{f}") for f in ("min", "max")]
        return made.select(key, *lists, *(c for c in ("radius",) if c in made.columns))

    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) + largest**2 - F.col("least") * 2.0
    radius = F.when(F.col("least").isNotNull(), F.sqrt(F.greatest(square, F.lit(0.0)))).otherwise(float("inf"))
    tiles = ranges(asking.withColumn("r", radius), "tile", "asked", F.max("r").alias("radius"))
    blocks = ranges(held, "block", "held")
    number = asking.agg(F.max("tile")).first()[0]
    if number is None:
        return asking.select("tile", F.lit(None).cast("long").alias("block")).limit(0)
    pairs = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(number)))).withColumn("tile", F.col("tile").cast("long")).join(tiles, "tile")
    gap = F.zip_with("tile_min", "block_max", lambda a, b: a - b), F.zip_with("block_min", "tile_max", lambda a, b: a - b)
    bound = F.greatest(F.array_max(gap[0]), F.array_max(gap[1]))
    farthest = F.greatest(F.array_max("tile_max"), F.array_max("block_max"))
    return pairs.filter(bound <= F.col("radius") + SLACK * farthest).select("tile", "block")
