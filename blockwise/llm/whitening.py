"""Whitening of embeddings by shifted CholeskyQR.

Entries are put on a grid of integers, ``floor(scale * c) + offset``. The fit list has each distinct grid vector
once; its count ``n`` and sums ``S`` are exact integers.

1. ``moments``: per task one row of count and sums, summed by dimension.
2. ``orthogonalise``: the centred rows ``A`` (``(n x - S) / n``, the numerator being exact) are read again and again.
   A pass solves ``Q R = A`` with the triangular factor so far and adds up the Gram matrix ``Q'Q`` of its rows; the
   Cholesky factor of that matrix extends ``R``. The first Gram matrix gets the shift ``11 (n d + d (d + 1)) u |A|^2``,
   so that its factor exists whatever the condition of ``A``; later ones a shift near rounding, and only if they are
   singular. At least three passes are made, the last from a ``Q`` that is nearly orthonormal.
3. The right singular vectors of the small factor ``R`` are the eigenvectors of the covariance, its squared singular
   values over ``n`` the eigenvalues.
4. ``whiten`` projects every row of the table in one narrow pass; a last Gram pass over the fit list measures how far
   the covariance of the whitened rows is from the identity.

To the driver come matrices of ``d`` by ``d`` doubles, already added up in about the square root of the number of tasks.

Defined results: a row whose vector is null, has null or non-finite entries, or entries of ``2 ** 40`` and more in
magnitude is left out; so is a vector whose length is not the most frequent one (of equally frequent ones the longest).
Repeated rows and repeated ids give a result each, a null id gives rows with a null id. Directions without variance
(below ``1e-18`` of the largest eigenvalue) have no component; fewer than two distinct vectors, or an empty table, give
no rows. The sign of a component makes its entry of largest magnitude positive. ``deviation`` raises if it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import by_value, fixed

by_value(__name__)

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries of this magnitude and more count as non-finite: the grid must stay exact in doubles.
LARGEST = 2.0**40
PASSES = 12
ROUNDING = 2.0**-53


@dataclass
class Whitening:
    """Components (columns of ``axes``) with eigenvalues, fitted on ``n`` vectors with sums ``sums``."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int = 0
    identity_error: float = 0.0


def on_grid(rows: DataFrame, vector_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``rows`` with usable vectors only, and their grid vector as array of longs in a column ``x``."""
    finite: Callable[[Column], Column] = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    doubles = F.col(vector_col).cast("array<double>")
    usable = rows.where(F.col(vector_col).isNotNull()).where(F.forall(doubles, finite))
    lengths = usable.groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("k"))
    most = lengths.agg(F.max(F.struct("k", "d"))["d"]).first()[0]
    grid = F.transform(doubles, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long"))
    return usable.where(F.size(vector_col) == F.lit(most if most is not None else 0)).withColumn("x", grid)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` from the exact ``n x - S``."""
    return _deviations(x, n, sums).astype(np.float64) / n


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``: longs where they hold it, else Python integers."""
    if x.size and n * int(np.abs(x).max()) + max(map(abs, sums)) >= 2**62:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _squares(dev: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if dev.dtype == object or (dev.size and dev.shape[1] * float(np.abs(dev).max()) ** 2 >= 2**62):
        return [sum(int(v) ** 2 for v in row) for row in dev]
    return (dev * dev).sum(axis=1).tolist()


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0))
            n += len(x)
            # halves of the bits are summed apart, so that no sum overflows
            part = np.stack([(x >> 24).sum(axis=0), (x & 0xFFFFFF).sum(axis=0)])
            sums = part if sums is None else sums + part
        if n:
            d = sums.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.concatenate([[n], sums[0]])), pa.array(np.concatenate([[0], sums[1]]))], names=["dim", "high", "low"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    parts = fit.select("x").mapInArrow(run, "dim long, high long, low long").groupBy("dim").agg(whole("high").alias("high"), whole("low").alias("low"))
    rows = {r.dim: (int(r.high), int(r.low)) for r in parts.collect()}
    if not rows:
        return 0, []
    return rows[-1][0], [(rows[i][0] << 24) + rows[i][1] for i in range(len(rows) - 1)]


def gram(fit: DataFrame, n: int, sums: list[int], right: np.ndarray | None = None, upper: np.ndarray | None = None) -> np.ndarray:
    """Sum over all rows of ``q' q``; q is the centred row, times ``right``, or solved against the triangle ``upper``."""

    def added(matrices: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for m in matrices:
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def products():
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    q = _centred(_vectors(batch.column(0).slice(a, 4096)), n, sums)
                    if upper is not None:
                        q = solved(q, upper)
                    if right is not None:
                        q = q @ right
                    yield q.T @ q

        return added(products())

    def of_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(np.frombuffer(g.as_py()) for batch in batches for g in batch.column(0))

    by_task = fit.select("x").mapInArrow(of_rows, "g binary")
    spread = max(1, round(fit.rdd.getNumPartitions() ** 0.5))
    rows = by_task.repartition(spread).mapInArrow(of_sums, "g binary").collect()  # at most ``spread`` matrices
    d = right.shape[1] if right is not None else len(sums)
    return sum((np.frombuffer(r.g).reshape(d, d) for r in rows), np.zeros((d, d)))


def solved(a: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``q`` with ``q @ upper == a`` by substitution from the first column on."""
    q = np.array(a, dtype=np.float64, order="F")
    for j in range(upper.shape[0]):
        if j:
            q[:, j] -= q[:, :j] @ upper[:j, j]
        q[:, j] /= upper[j, j]
    return q


def orthogonalise(gram_of: Callable[[np.ndarray | None], np.ndarray], n: int, d: int) -> tuple[np.ndarray, int]:
    """The triangular factor ``R`` with ``A = Q R``, and the passes taken; ``gram_of`` gives ``Q'Q`` of ``Q`` for the factor so far."""
    r, passes = None, 0
    while True:
        g = gram_of(r)
        passes += 1
        eigen = np.linalg.eigvalsh(g)
        norm = float(eigen[-1])
        if norm <= 0:
            return np.zeros((d, d)), passes
        # Directions without variance never reach length 1; their share of R shrinks from pass to pass instead.
        settled = passes >= 3 and ((np.abs(eigen - 1) < 1e-2) | (eigen < 1e-6)).all()
        shift = 11 * (n * d + d * (d + 1)) * ROUNDING * norm if r is None else 0.0
        if r is not None and eigen[0] <= 4 * d * ROUNDING * norm:
            shift = 8 * d * ROUNDING * norm
        while True:
            try:
                step = np.linalg.cholesky(g + shift * np.eye(d)).T
                break
            except np.linalg.LinAlgError:
                shift = max(8 * d * ROUNDING * norm, 10 * shift)
        r = step if r is None else step @ r
        if settled or passes >= PASSES:
            return r, passes


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct grid vectors of ``fit`` (column ``x``); None if there are none."""
    n, sums = moments(fit)
    if not n:
        return None
    d = len(sums)
    r, passes = orthogonalise(lambda upper: gram(fit, n, sums, upper=upper), n, d) if d else (np.zeros((0, 0)), 0)
    _, sigma, right = np.linalg.svd(r)
    eigenvalues = sigma**2 / n
    rank = int((eigenvalues > 1e-18 * eigenvalues.max(initial=0)).sum()) if n > 1 else 0
    axes = right[: min(components, rank)].T
    if axes.size:
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    found = Whitening(n, sums, axes, eigenvalues[: axes.shape[1]], float(eigenvalues.sum()), passes)
    if axes.shape[1]:
        covariance = gram(fit, n, sums, right=axes / np.sqrt(found.eigenvalues)) / n
        found.identity_error = float(np.abs(covariance - np.eye(axes.shape[1])).max())
    return found


def whiten(rows: DataFrame, w: Whitening, id_col: str = "vec_id") -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each row (column ``x``) and component."""
    k = w.axes.shape[1]
    right, explained = w.axes / np.sqrt(w.eigenvalues), w.eigenvalues / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                dev = _deviations(_vectors(part.column(1)), w.n, w.sums)
                m = len(dev)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, w.n, np.int64)),
                        pa.array([s for s in _squares(dev) for _ in range(k)], pa.int64()),
                        pa.array(((dev.astype(np.float64) / w.n) @ right).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, w.identity_error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.select(id_col, "x").mapInArrow(run, schema)


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """Fits on the distinct vectors of ``rows`` and whitens every row."""
    given = on_grid(rows.select(F.col(id_col), F.col(vector_col)), vector_col, scale, offset).select(id_col, "x")
    fit = fixed(given.select("x").distinct(), "whitening-fit")
    w = fit_whitening(fit, components) or Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    return whiten(given, w, id_col)
