"""Exact top-k against all integer inner products, and against DuckDB."""

import numpy as np
from pyspark.sql import functions as F

from checks.compare import database, spark_rows, sql_rows
from clicktrail.llm import queries
from clicktrail.llm.topk import distances, farthest_first, nearest, search
from tests.llm.conftest import CLASHING, TABLES


def exact(rows, k=20, every=20):
    ids = [i for i, _ in rows]
    x = np.array([[int(np.floor(float(c) * 64)) for c in v] for _, v in rows], dtype=object)
    out = {}
    for n, i in enumerate(ids):
        if i % every == 0:
            scores = x @ x[n]
            out[i] = [(int(ids[j]), int(scores[j])) for j in sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j])) if ids[j] != i][:k]
    return {q: v for q, v in out.items() if v}


def found(df, **options):
    out = {}
    for r in search(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def table(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumns({c: F.lit("x") for c in [*CLASHING, "id", "x", "query", "held", "asked", "block", "cell", "grp", "pos", "own", "least"]})


def test_given_embeddings_in_sql(spark):
    assert spark_rows(queries.largest_products(spark, TABLES)) == sql_rows(database(TABLES), queries.oracle_sql()["op13_topk"])


def test_many_blocks_and_tiles(spark):
    """Clusters, lengths that differ much, a vector that stands 400 times, and ties."""
    draw = np.random.default_rng(7)
    middle = draw.normal(size=(6, 12)) * 4
    x = np.float32((middle[draw.integers(0, 6, 2_000)] + draw.normal(size=(2_000, 12)) * 0.1) * draw.lognormal(0, 0.4, (2_000, 1)))
    x[500:900] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    wanted = exact(rows)
    for block in (64, 300, 100_000):
        assert found(table(spark, rows), block=block, pivots=8) == wanted, block


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (1, [0.25, 0.0]), (40, None), (60, [0.0, 0.0])]
    got = found(table(spark, rows))
    assert got == {0: [(1, 2048), (3, 0), (60, 0), (20, -4096)], 20: [(3, 0), (60, 0), (1, -2048), (0, -4096)], 60: [(0, 0), (1, 0), (3, 0), (20, 0)]}
    assert found(table(spark, rows[2:3])) == {} and found(table(spark, rows).limit(0)) == {}
    assert found(table(spark, [(0, [1.0, 2.0])])) == {} and found(table(spark, [(1, [1.0]), (2, [2.0])])) == {}


def test_large_numbers_are_exact(spark):
    draw = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(draw.integers(-(1 << 22), 1 << 22, size=(60, 6)) * 1.0)]
    assert found(table(spark, rows, "double"), block=16) == exact(rows)


def test_the_search_stops_early_and_misses_nothing():
    """On clustered rows most candidates are never scored."""
    from clicktrail.llm import topk

    draw = np.random.default_rng(9)
    middle = draw.normal(size=(40, 16)) * 100
    x = np.round(middle[np.arange(4_000) % 40] + draw.normal(size=(4_000, 16))).astype(np.int64)
    x = (x / np.sqrt((x**2).sum(axis=1))[:, None] * 1000).astype(np.int64)
    largest = float(np.sqrt((x**2).sum(axis=1).max()))
    fill = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
    chosen = farthest_first(np.hstack([x, fill[:, None]]), 24)
    held, asked = distances(x.astype(float), fill, x[chosen].astype(float), fill[chosen]), distances(x.astype(float), np.zeros(len(x)), x[chosen].astype(float), fill[chosen])
    ids, some = np.arange(len(x)), np.arange(0, 4_000, 40)
    scored, whole = [0], topk._scores
    topk._scores = lambda q, r: (scored.__setitem__(0, scored[0] + q.shape[0] * r.shape[0]), whole(q, r))[1]
    try:
        q, r, s = nearest(ids[some], x[some], asked[some].astype(np.float32), np.full(len(some), -np.inf), ids, x, held.astype(np.float32), largest, 20, together=16, step=100)
    finally:
        topk._scores = whole
    assert scored[0] < 0.2 * len(some) * len(x)
    for i in some:
        scores = x @ x[i]
        best = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-scores[j], j))[:20]
        mine = sorted(zip(-s[q == i], r[q == i], strict=True))
        assert [int(j) for _, j in mine] == best
