"""Nearest neighbours against all inner products."""

import numpy as np
from pyspark.sql import functions as F

from clicktrail.llm.neighbours import Hashing, probe_order, search
from tests.llm.conftest import CLASHING


def exact(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df, **options):
    out = {}
    for r in search(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, wanted):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in wanted.items() if w])


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("x") for c in [*CLASHING, "id", "vector", "bucket", "query", "parts", "table"]})


def test_given_embeddings(spark):
    for scale in ("0.01", "0.1"):
        df = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
        rows = df.select("vec_id", "embedding").collect()
        ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
        got, wanted = found(df), exact(ids, x)
        assert got.keys() == wanted.keys() and all(len(v) == 20 for v in got.values())
        assert recall(got, wanted) >= 0.9
        at = {int(i): n for n, i in enumerate(ids)}
        assert all(abs(s - x[at[q]] @ x[at[i]]) < 1e-12 for q, v in got.items() for i, s in v)


def test_unequal_lengths_ties_and_a_hot_vector(spark):
    draw = np.random.default_rng(4)
    x = (draw.normal(size=(900, 8)) * draw.lognormal(0, 0.7, (900, 1))).astype(np.float32)
    x[300:650] = x[0]
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got, wanted = found(df, block=64), exact(np.arange(900), x.astype(float))
    assert recall(got, wanted) >= 0.9
    assert found(df) == got
    # A tie goes to the smaller id.
    assert [i for i, _ in got[400]][: len(wanted[400])] == [i for i, _ in wanted[400]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (1, [0.25, 0.0]), (40, None), (60, [0.0, 0.0])]
    got = found(vectors(spark, rows))
    assert got == {0: [(1, 0.5), (20, -1.0)], 20: [(1, -0.25), (0, -1.0)]}
    assert found(vectors(spark, rows[2:3])) == {}
    assert found(vectors(spark, rows).limit(0)) == {}
    assert found(vectors(spark, [(0, [1.0, 2.0])])) == {}


def test_few_rows_are_all_found(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(15, 32)).astype(np.float32)
    got = found(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), tables=1, hashes=8, width=0.3, probes=1)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in exact(np.arange(15), x.astype(float)).items()}


def test_probes_come_in_order_and_move_a_projection_one_way():
    order = probe_order(4, 40)
    assert order[0] == () and order[1] == (0,) and len(set(order)) == len(order)
    assert all(not any(7 - i in chosen for i in chosen) for chosen in order)


def test_more_probes_find_more():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(500, 16))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    few, many = (Hashing(16, 1.0, 2, 4, 1.0, n, 1) for n in (1, 20))
    assert (few.probed(x)[:, :, 0] == few.buckets(x)).all()
    near = np.argsort(-(x @ x.T), axis=1)[:, 1]
    hits = [np.mean([set(h.probed(x[i : i + 1])[0, 0].tolist()) & {h.buckets(x[near[i] : near[i] + 1])[0, 0]} != set() for i in range(60)]) for h in (few, many)]
    assert hits[1] > hits[0]
