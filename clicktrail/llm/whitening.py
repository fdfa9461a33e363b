"""Whitening of embeddings by a Jacobi-Davidson eigensolver that never holds the covariance.

Spark computes products of the centred covariance with a few vectors at a time: each task multiplies its rows, centred,
with the vectors and back, and the partial sums are added up per cell. The driver holds only blocks of vectors of the
embeddings' length. Rayleigh-Ritz on a growing subspace gives approximate eigenpairs; the subspace grows by solutions of
the projected correction equations, all wanted pairs side by side, each by inner MINRES on the same distributed product.
Pairs whose residual is at rounding level are locked; the search ends when all wanted ones are.

Whitening works on integers floor(scale * c) + shift. Sums of them are exact, and rows are centred as small integers less
a remainder under 1, so a large shift costs no digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.sources.scratch import written

Product = Callable[[np.ndarray], np.ndarray]
EXACT = 1 << 62


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to ``against``; directions that add nothing are left out."""
    block = block / np.maximum(np.sqrt((block**2).sum(axis=0)), 1e-300)  # corrections shrink with the residuals
    for _ in range(3):
        block = block - against @ (against.T @ block)
        norms = np.sqrt((block**2).sum(axis=0))
        block = block[:, norms > 1e-10] / norms[norms > 1e-10]
        if not block.size:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * s[0]]
    return block


def minres(product: Product, shifts: np.ndarray, wanted: np.ndarray, basis: np.ndarray, own: np.ndarray, steps: int, enough: float) -> np.ndarray:
    """Approximate solutions t of P (A - shift) P t = wanted, a column for each shift, by MINRES side by side.

    P projects onto what is orthogonal to ``basis`` (the locked vectors) and to the column's ``own`` vector. Every step
    is one product with all columns. It ends after ``steps`` or when all residuals fell by the factor ``enough``.
    """

    def projected(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - basis @ (basis.T @ x)
            x = x - own * (own * x).sum(axis=0)
        return x

    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x, 1.0)

    v = projected(wanted)
    start = beta = np.sqrt((v**2).sum(axis=0))
    v, before = v / safe(beta), np.zeros_like(v)
    solution, last, last_but_one = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    cosine, sine, cosine0, sine0 = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    rest, beta_in = beta.copy(), np.zeros_like(beta)
    going = start > 0
    for _ in range(steps):
        if not going.any():
            break
        image = np.zeros_like(v)
        image[:, going] = product(v[:, going]) - v[:, going] * shifts[going]
        image = projected(image) - before * beta_in
        alpha = (v * image).sum(axis=0)
        image = projected(image - v * alpha)
        beta = np.sqrt((image**2).sum(axis=0))
        # Two earlier rotations on the new column of the tridiagonal matrix, then one more.
        far = sine0 * beta_in
        middle = cosine0 * beta_in
        near, diagonal = cosine * middle + sine * alpha, cosine * alpha - sine * middle
        length = np.sqrt(diagonal**2 + beta**2)
        going = going & (length > 1e-14 * (np.abs(shifts) + np.abs(alpha)))
        cosine0, sine0 = cosine, sine
        cosine, sine = np.where(going, diagonal / safe(length), 1.0), np.where(going, beta / safe(length), 0.0)
        direction = np.where(going, (v - near * last - far * last_but_one) / safe(length), 0.0)
        solution = solution + np.where(going, cosine * rest, 0.0) * direction
        rest = np.where(going, -sine * rest, rest)
        last_but_one, last = last, direction
        before, v, beta_in = v, image / safe(beta), beta
        going = going & (np.abs(rest) > enough * start) & (beta > 1e-13 * np.abs(shifts))
    return projected(solution)


@dataclass(frozen=True)
class EigenPairs:
    """Eigenvalues in falling order, unit eigenvectors as columns, and the largest residual over the largest eigenvalue."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float


def jacobi_davidson(product: Product, dimension: int, count: int, trace: float, tolerance: float = 2e-14, inner: int = 8, room: int = 3, rounds: int = 200, seed: int = 3) -> EigenPairs:
    """The ``count`` largest eigenpairs of a symmetric positive semidefinite matrix that is known by its product only.

    Residuals end at ``tolerance`` times the trace or less (the trace bounds the largest eigenvalue, and rounding errors
    of a sum over all rows follow it). The subspace holds at most ``room`` times the wanted vectors (and 20 more), then it
    is cut to its best half. Raises ArithmeticError where ``rounds`` don't suffice.
    """
    count = min(count, dimension)
    if not count or trace <= 0:
        return EigenPairs(np.zeros(0), np.zeros((dimension, 0)), 0.0)
    draw = np.random.default_rng(seed)
    most, none = min(dimension, room * count + 20), np.zeros((dimension, 0))
    space = _orthonormal(draw.standard_normal((dimension, min(dimension, count + 4))), none)
    image = product(space)
    locked, values, worst = none, np.zeros(0), 0.0
    limit = tolerance * trace
    for _ in range(rounds):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_image = space @ turn, image @ turn
        left = count - locked.shape[1]
        residual = ritz_image[:, :left] - ritz[:, :left] * theta[:left]
        residual -= locked @ (locked.T @ residual)
        norms = np.sqrt((residual**2).sum(axis=0))
        # Only leading pairs are locked: one behind an open one may still move down.
        ready = left if (norms <= limit).all() else int(np.argmin(norms <= limit))
        if ready and (ready == left or ready >= 4):
            locked, values = np.hstack([locked, ritz[:, :ready]]), np.append(values, theta[:ready])
            worst = max(worst, float(norms[:ready].max()))
            ritz, ritz_image, theta = ritz[:, ready:], ritz_image[:, ready:], theta[ready:]
            residual, norms = residual[:, ready:], norms[ready:]
        if len(values) == count:
            order = np.argsort(-values, kind="stable")
            return EigenPairs(values[order], locked[:, order], worst / trace)
        open_ = np.flatnonzero(norms > limit)
        if ritz.shape[1] + len(open_) > most - locked.shape[1] and ritz.shape[1] + locked.shape[1] < dimension:
            ritz, ritz_image = ritz[:, : max(count - len(values), most // 2 - len(values))], ritz_image[:, : max(count - len(values), most // 2 - len(values))]
        found = minres(product, theta[open_], -residual[:, open_], locked, ritz[:, open_], inner, 0.05)
        more = _orthonormal(found, np.hstack([locked, ritz]))
        if not more.size:  # the corrections are spent: other directions
            more = _orthonormal(draw.standard_normal((dimension, 4)), np.hstack([locked, ritz]))
        if not more.size:  # the whole space is searched: products once more, without the errors of many turns
            space = _orthonormal(ritz, locked)
            image = product(space)
        else:
            space, image = np.hstack([ritz, more]), np.hstack([ritz_image, product(more)])
        image = image - locked @ (locked.T @ image)
    raise ArithmeticError(f"residuals above {limit:g} after {rounds} rounds")


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def covariance_product(rows: DataFrame, column: str, middle: np.ndarray, rest: np.ndarray, n: int) -> Product:
    """v to V v for blocks of vectors, V the covariance (divisor n) of the integer vectors in ``column``.

    The mean is ``middle + rest``, integers and a remainder. Every call is one pass over the rows.
    """
    length = len(middle)

    def product(block: np.ndarray) -> np.ndarray:
        wide = block.shape[1]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((length, wide))
            for batch in batches:
                if len(batch):
                    centred = (_matrix(batch.column(0), length) - middle) - rest
                    total += centred.T @ (centred @ block)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(length * wide)), pa.array(total.ravel())], ["cell", "part"])

        cells = rows.select(column).mapInArrow(partial, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("whole")).toArrow()
        out = np.zeros(length * wide)
        out[cells.column("cell").to_numpy()] = cells.column("whole").to_numpy()
        return out.reshape(length, wide) / n

    return product


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Project every vector onto the largest principal components, each divided by its standard deviation.

    A component c counts as the integer floor(scale * c) + shift, in double precision. All rows that are left take part
    in the fit. Returns a row for each row left and component: the id column's value as ``vec_id``, component (from 1, by
    falling variance), n (rows), deviation (sum over dimensions of (n * x - S)^2, exact; null where it is over 2^62),
    whitened, explained (share of the trace), identity_error (largest entry of whitened's covariance less the identity).

    Vectors that are null, empty, hold a null or a non-finite number, or have another length than most (the shorter of
    equally frequent ones counts) are left out, and so are those with an integer over 2^53 in size. Null and repeated
    ids are rows like any other; equal rows get equal values. Components without variance, as with one row or equal rows
    only, are left out. An empty table gives an empty result. Other columns, whatever their names, are not read.
    """
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    usable = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**53))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(scale)) + F.lit(shift))
    rows = written(vectors.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x")), "whitening-rows")
    lengths = rows.filter(F.size("x") > 0).groupBy(F.size("x").alias("length")).count().collect()
    if not lengths:
        return spark.createDataFrame([], result)
    most = max(lengths, key=lambda r: (r["count"], -r["length"]))
    length, n = most["length"], most["count"]
    rows = rows.filter(F.size("x") == length)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * length
        for batch in batches:
            for a in range(0, len(batch), 512):  # 512 integers of at most 2^53 fit
                total = [s + int(t) for s, t in zip(total, _matrix(batch.column(0).slice(a, 512), length).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(length), pa.int32()), pa.array(list(map(str, total)), pa.string())], ["place", "total"])

    met = rows.select("x").mapInArrow(sums, "place int, total string").groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = [int(r["total"]) for r in sorted(met, key=lambda r: r["place"])]
    middle = np.array([s // n for s in total], dtype=np.int64)
    over = [s % n for s in total]
    rest = np.array(over, dtype=float) / n
    product = covariance_product(rows, "x", middle, rest, n)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (pa.RecordBatch.from_arrays([pa.array([float((((_matrix(b.column(0), length) - middle) - rest) ** 2).sum())])], ["square"]) for b in batches if len(b))

    trace = rows.select("x").mapInArrow(squares, "square double").agg(F.sum("square")).first()[0] / n
    pairs = jacobi_davidson(product, length, components, trace)
    kept = pairs.values > 1e-12 * trace
    if not kept.any():
        return spark.createDataFrame([], result)
    values = pairs.values[kept]
    axes = pairs.vectors[:, kept] / np.sqrt(values)
    error = float(np.abs(_whitened_covariance(rows, middle, rest, n, axes) - np.eye(len(values))).max())
    explained, wide = values / trace, len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a in range(0, len(whole_batch), 1024):
                batch = whole_batch.slice(a, 1024)
                small = _matrix(batch.column(1), length) - middle
                out = (small - rest) @ axes
                deviation = pa.array(_deviations(small, over, n), pa.int64())
                every = pa.array(np.repeat(np.arange(len(batch)), wide))
                again = len(batch)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(every),
                        pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), again)),
                        pa.array(np.full(again * wide, n)),
                        deviation.take(every),
                        pa.array(out.ravel()),
                        pa.array(np.tile(explained, again)),
                        pa.array(np.full(again * wide, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(project, result)


def _whitened_covariance(rows: DataFrame, middle: np.ndarray, rest: np.ndarray, n: int, axes: np.ndarray) -> np.ndarray:
    """Covariance of the rows' whitened values, from the values themselves, centred by their own mean."""
    length, wide = axes.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide + 1, wide))
        for batch in batches:
            if len(batch):
                out = ((_matrix(batch.column(0), length) - middle) - rest) @ axes
                total[:wide] += out.T @ out
                total[wide] += out.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "part"])

    cells = rows.select("x").mapInArrow(partial, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("whole")).toArrow()
    flat = np.zeros((wide + 1) * wide)
    flat[cells.column("cell").to_numpy()] = cells.column("whole").to_numpy()
    sums = flat.reshape(wide + 1, wide) / n
    # The values are centred to rounding already; what is left of their mean is taken out.
    return sums[:wide] - np.outer(sums[wide], sums[wide])


def _deviations(small: np.ndarray, over: list[int], n: int) -> list[int | None]:
    """Sums of (n * x - S)^2 for x - S // n in ``small`` and S % n in ``over``; null where one doesn't fit."""
    largest = n * (int(np.abs(small).max(initial=0)) + 1)
    if largest**2 * max(1, small.shape[1]) < EXACT:
        return (((small * n - np.array(over, dtype=np.int64)) ** 2).sum(axis=1)).tolist()
    sums = [sum((n * int(x) - r) ** 2 for x, r in zip(row, over, strict=True)) for row in small.tolist()]
    return [s if s < EXACT else None for s in sums]
