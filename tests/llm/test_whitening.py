"""Whitening against numpy's own eigensolver and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktrail.llm.whitening import jacobi_davidson, minres, whiten
from tests.llm.conftest import CLASHING, TABLES


def table(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumns({c: F.lit("x") for c in [*CLASHING, "x", "component", "deviation", "whitened", "explained"]})


def check(df, vectors, ids, components=32, scale=64.0, shift=1_000_000):
    """Compare with integers in Python and with ``eigh``; returns the rows by id."""
    x = [[int(np.floor(np.float64(c) * scale)) + shift for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    total = [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[float(n * a - s) for a, s in zip(v, total, strict=True)] for v in x]) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    found = {}
    for r in df.collect():
        found.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(found) == sorted(ids)
    wide = len(next(iter(found.values())))
    assert wide == min(components, d, int((values > 1e-12 * values.sum()).sum()))
    white = np.array([[found[i][c].whitened for c in range(1, wide + 1)] for i in ids])
    assert np.abs(white.T @ white / n - np.outer(white.mean(axis=0), white.mean(axis=0)) - np.eye(wide)).max() < 1e-9
    for i, v in zip(ids, x, strict=True):
        for c in range(1, wide + 1):
            r = found[i][c]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, total, strict=True))
            assert abs(r.explained - values[c - 1] / values.sum()) < 1e-12 and r.identity_error < 1e-9
    for c in range(wide):
        gap = min(abs(values[c] - values[j]) for j in range(d) if j != c) if d > 1 else 1.0
        if gap > 1e-6 * values[0]:
            wanted = centred @ axes[:, c] / np.sqrt(values[c])
            sign = np.sign(wanted @ white[:, c])
            assert np.abs(wanted * sign - white[:, c]).max() < 1e-12 * values[0] / gap * max(1.0, np.abs(wanted).max()) * 100
    return found


def test_given_embeddings(spark):
    df = spark.read.parquet(f"{TABLES}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    check(whiten(df), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_more_dimensions_than_the_subspace_holds(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(400, 60)) * (1.0 / np.arange(1, 61) ** 1.5) * 30
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "double")
    check(whiten(df, components=4), x, list(range(400)), components=4)


def test_a_large_mean_costs_no_digits(spark):
    x = np.random.default_rng(2).normal(size=(200, 5)) + 1e9
    check(whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "double")), x, list(range(200)))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    draw = np.random.default_rng(3)
    good = [(i, [float(np.float32(c)) for c in draw.normal(size=3)]) for i in range(20)]
    good[4] = (4, [0.0, 0.0, 0.0])
    odd = [(100, None), (101, []), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, [None, 1.0, 1.0]), (105, [1.0]), (106, [1.0, 2.0, 3.0, 4.0])]
    check(whiten(table(spark, good + odd)), [v for _, v in good], [i for i, _ in good])
    assert whiten(table(spark, odd[:5])).collect() == []
    assert whiten(table(spark, good).limit(0)).collect() == []
    # Neither one row nor equal rows have any variance.
    assert whiten(table(spark, good[:1])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    # A repeated row counts twice and gets equal values; so do rows without an id.
    twice = whiten(table(spark, [*good, good[0], (None, good[1][1]), (None, good[1][1])])).collect()
    assert len(twice) == 23 * 3 and all(r.n == 23 for r in twice)
    assert len({(r.component, r.whitened) for r in twice if r.vec_id == 0}) == 3 and sum(r.vec_id is None for r in twice) == 6


def test_fewer_directions_than_dimensions(spark):
    """Two dimensions always move together: one component less."""
    x = np.random.default_rng(4).integers(-9, 9, size=(90, 3)).astype(float)
    x = np.hstack([x, x[:, :1]])
    check(whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(x)], "double")), x, list(range(90)))


@pytest.mark.parametrize("kind", ["decay", "gap", "cluster", "equal", "flat"])
def test_solver_reaches_rounding_level(kind):
    d, k = 160, 12
    draw = np.random.default_rng(5)
    q, _ = np.linalg.qr(draw.normal(size=(d, d)))
    values = {
        "decay": 1.0 / np.arange(1, d + 1),
        "gap": np.r_[np.linspace(100, 50, k), np.linspace(1, 0.1, d - k)],
        "cluster": 1 + 1e-6 * draw.uniform(size=d),
        "equal": np.r_[np.full(20, 2.0), np.linspace(1, 0.5, d - 20)],
        "flat": draw.uniform(1, 2, d),
    }[kind]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    pairs = jacobi_davidson(lambda block: a @ block, d, k, float(np.trace(a)))
    assert np.abs(pairs.values - np.sort(values)[::-1][:k]).max() < 1e-13 * d * values.max()
    assert np.abs(a @ pairs.vectors - pairs.vectors * pairs.values).max() <= 4e-14 * np.trace(a)
    assert np.abs(pairs.vectors.T @ pairs.vectors - np.eye(k)).max() < 1e-13


def test_minres_solves_the_projected_equation():
    d = 120
    draw = np.random.default_rng(6)
    q, _ = np.linalg.qr(draw.normal(size=(d, d)))
    a = (q / np.arange(1, d + 1)) @ q.T
    own = np.linalg.qr(draw.normal(size=(d, 5)))[0]
    basis, own = own[:, :2], own[:, 2:]
    shifts, wanted = np.array([0.3, 0.02, -1.0]), draw.normal(size=(d, 3))
    wanted -= basis @ (basis.T @ wanted)
    wanted -= own * (own * wanted).sum(axis=0)
    t = minres(lambda block: a @ block, shifts, wanted, basis, own, 400, 1e-12)
    left = a @ t - t * shifts
    left -= basis @ (basis.T @ left)
    left -= own * (own * left).sum(axis=0)
    size = np.abs(t).max()
    assert np.abs(left - wanted).max() < 1e-8 and np.abs(basis.T @ t).max() < 1e-14 * size and np.abs((own * t).sum(axis=0)).max() < 1e-14 * size
