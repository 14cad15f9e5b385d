"""Embedding whitening by Jacobi-Davidson.

The covariance of the distinct vectors is never formed: every use of it is a product with a thin matrix, one Spark job
that centres each vector, multiplies and adds up.  A subspace grows by the solutions of correction equations, which a few
steps of MINRES solve in the complement of what is found; the steps of all equations go together, so that a step is one
job.  Rayleigh-Ritz on the subspace gives the next approximations, and those whose residual has come down to rounding are
locked.  What the driver holds is of the size (numbers of a vector) x (columns of the subspace), whatever the rows.

Vectors become whole numbers first.  A distinct vector is stored once, in blocks of whole numbers less the offset, in as
few bytes as they need.  Blocks are filled from few enough partitions that each task of a product has many vectors, so the
sums that tasks hand on follow the vectors and not the partitions that these came in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written

SCALE, OFFSET = 64, 1_000_000
#: Vectors of a stored block, and of a task.
BLOCK, TASK = 4096, 1 << 16
#: Pairs beyond those asked for that take part, columns the subspace may have as a multiple of the pairs, MINRES steps.
GUARD, WIDEST, STEPS = 4, 3, 10
#: A residual is at rounding when it is so many times the spacing of doubles at the largest eigenvalue.
ROUNDING = 64
_EPS = np.finfo(np.float64).eps

WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(64 * c) of doubles, without the offset; what a long cannot hold stays at its end."""
    edge = float(1 << 62)
    return np.floor(np.clip(SCALE * values, -edge, edge)).astype(np.int64)


def _rows_of(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the entries that have ``size`` finite components and nothing else."""
    places, found = [], []
    for at, entry in enumerate(column):
        if entry.is_valid and len(entry.values) == size and entry.values.null_count == 0:
            vector = entry.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(vector).all():
                places.append(at)
                found.append(vector)
    return np.array(places, np.int64), np.array(found, np.float64).reshape(len(found), size)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that all of them fit in; the first byte tells how many."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind[2].encode() + values.astype(kind).tobytes()


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<i{packed[:1].decode()}", offset=1)


def _encoded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(_rows_of(batch.column(0), size)[1])
            yield pa.RecordBatch.from_arrays([pa.array([_narrow(v) for v in x], pa.binary())], ["x"])

    return run


def _blocked(size: int):
    """Distinct vectors to blocks of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([_narrow(np.concatenate(held))], pa.binary())], ["n", "x"])

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                held.append(_wide(packed))
                if len(held) == BLOCK:
                    yield block()
                    held.clear()
        if held:
            yield block()

    return run


def _sums(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                x = _wide(packed).reshape(-1, size)
                total = x.astype(object).sum(0) if x.itemsize == 8 else x.sum(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([str(t) for t in total], pa.string())], ["at", "total"])

    return run


def _added(size: int, mean: np.ndarray, make: Callable[[np.ndarray], np.ndarray]):
    """The sum over all centred vectors of what ``make`` gives for a block of them, per task, as (place, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total = total + make(_wide(packed).reshape(-1, size).astype(np.float64) - mean)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "part"])

    return run


class Centred:
    """The distinct vectors, their sums and their covariance as an operator on thin matrices."""

    def __init__(self, blocks: DataFrame, size: int):
        self.blocks, self.size = blocks.select("x"), size
        self.n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        sums = self.blocks.mapInArrow(_sums(size), "at int, total string").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found = {r["at"]: int(r["total"]) for r in sums.collect()}
        self.sums = [found.get(i, 0) for i in range(size)]
        self.mean = np.array([t / max(1, self.n) for t in self.sums])
        self.jobs = 0

    def added(self, make: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """One job: the sum of ``make`` over the blocks, divided by the number of vectors."""
        self.jobs += 1
        out = np.zeros(int(np.prod(shape)))
        for r in self.blocks.mapInArrow(_added(self.size, self.mean, make), "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():
            out[r["at"]] = r["part"]
        return out.reshape(shape) / self.n

    def times(self, u: np.ndarray) -> np.ndarray:
        return self.added(lambda c: c.T @ (c @ u), u.shape)


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The directions of ``new`` outside the span of ``against``, orthonormal; those that are nothing but rounding go."""
    norms = np.linalg.norm(new, axis=0)
    new = new[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        new = new - against @ (against.T @ new)
    left, scale, _ = np.linalg.svd(new, full_matrices=False)
    new = left[:, scale > 1e-8]
    new = new - against @ (against.T @ new)
    return np.linalg.qr(new)[0] if new.shape[1] else new


def minres(times: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, enough: np.ndarray) -> np.ndarray:
    """The columns x with least ``times(x) - right`` in the Krylov spaces of ``steps`` products, all columns at once.

    ``times`` is symmetric on every column by itself; it ends when each column's residual is at most ``enough``.
    """
    x = np.zeros_like(right)
    before, beta = np.zeros_like(right), np.linalg.norm(right, axis=0)
    live = beta > 0
    v = np.divide(right, beta, where=live, out=np.zeros_like(right))
    phi = beta.copy()
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    c_old, s_old, c, s = np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        live = live & (np.abs(phi) > enough)
        if not live.any():
            break
        p = times(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * before
        following = np.linalg.norm(p, axis=0)
        # two rotations of the columns before, then the one that removes the entry below
        far, near, diagonal = s_old * beta, c_old * c * beta + s * alpha, -c_old * s * beta + c * alpha
        r = np.hypot(diagonal, following)
        live = live & (r > 0)
        safe = np.where(r > 0, r, 1.0)
        c_old, s_old = c, s
        c, s = diagonal / safe, following / safe
        w_old, w = w, (v - near * w - far * w_old) / safe
        x = x + np.where(live, c * phi, 0.0) * w
        phi = np.where(live, -s * phi, phi)
        before, v = v, np.divide(p, following, where=following > 0, out=np.zeros_like(p))
        live, beta = live & (following > 0), following
    return x


def leading_pairs(times: Callable[[np.ndarray], np.ndarray], size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns): the ``wanted`` largest of a covariance given by its products.

    Pairs without variance, up to rounding, are left out.
    """
    rng = np.random.default_rng(7)
    together = min(size, wanted + GUARD)
    widest = min(size, WIDEST * together)
    locked, values = np.zeros((size, 0)), np.zeros(0)
    basis = _orthonormal(rng.standard_normal((size, together)), locked)
    image = times(basis)
    largest = smallest_residual = 0.0
    stalled = 0
    while basis.shape[1]:
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        largest = max(largest, theta[0], *values)
        residual = image - basis * theta
        residual -= locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        bar = ROUNDING * _EPS * max(largest, np.finfo(np.float64).tiny)
        # where rounding of the products itself is larger, residuals stop falling: that is as far as doubles go
        stalled = stalled + 1 if smallest_residual and norms[0] > smallest_residual / 2 and norms[0] < 1e-10 * largest else 0
        smallest_residual = norms[0]
        first = 0
        while first < len(theta) and (norms[first] <= bar or stalled >= 4 and norms[first] < 1e-10 * largest):
            first += 1
        if first:
            stalled, smallest_residual = 0, 0.0
            locked, values = np.hstack([locked, basis[:, :first]]), np.append(values, theta[:first])
            basis, image, theta, residual = basis[:, first:], image[:, first:], theta[first:], residual[:, first:]
        weakest = np.sort(values)[::-1][wanted - 1] if len(values) >= wanted else -np.inf
        if len(values) >= size or len(theta) and theta[0] <= max(weakest, size * ROUNDING * _EPS * largest):
            break
        if not len(theta):
            basis = _orthonormal(rng.standard_normal((size, together)), locked)
            image = times(basis)
            continue
        some = min(together, len(theta))
        aim, held = theta[:some], np.hstack([locked, basis[:, :some]])

        def outside(t: np.ndarray, held: np.ndarray = held) -> np.ndarray:
            return t - held @ (held.T @ t)

        def shifted(t: np.ndarray, aim: np.ndarray = aim, outside: Callable = outside) -> np.ndarray:
            return outside(times(t) - t * aim)

        right = -outside(residual[:, :some])
        steps = min(STEPS, size - held.shape[1])
        new = minres(shifted, right, steps, np.maximum(bar / 4, 1e-3 * np.linalg.norm(right, axis=0))) if steps else right
        if basis.shape[1] + some > widest - len(values):  # thick restart
            keep = min(basis.shape[1], 2 * some)
            basis, image = basis[:, :keep], image[:, :keep]
        new = _orthonormal(new, np.hstack([locked, basis]))
        if not new.shape[1]:  # no direction is left: the subspace holds all there is, up to rounding of the images
            image = times(basis)
            stalled += 1
            if stalled < 4:
                continue
            new = _orthonormal(rng.standard_normal((size, together)), np.hstack([locked, basis]))
            if not new.shape[1]:
                locked, values = np.hstack([locked, basis]), np.append(values, theta)
                break
        basis, image = np.hstack([basis, new]), np.hstack([image, times(new)])
    if not locked.shape[1]:
        return values, locked
    # one more Rayleigh-Ritz over all that is locked, with products of the vectors themselves
    locked = np.linalg.qr(locked)[0]
    small = locked.T @ times(locked)
    theta, turn = np.linalg.eigh((small + small.T) / 2)
    theta, vectors = theta[::-1][:wanted], (locked @ turn)[:, ::-1][:, :wanted]
    real = theta > size * ROUNDING * _EPS * theta[0]
    return theta[real], vectors[:, real]


def _exact(size: int, n: int, sums: list[int], x: np.ndarray) -> list[int | None]:
    """sum((n*x - S)^2) of every row; None where a long cannot hold it."""
    about = ((n * x.astype(np.float64) - np.array(sums, np.float64)) ** 2).sum(1)
    far = n * np.abs(x.astype(np.float64)).max(initial=0) + float(max(map(abs, sums), default=0))
    if about.max(initial=0) < 2.0**62 and far < 2.0**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    found = [sum((n * int(v) - t) ** 2 for v, t in zip(row, sums, strict=True)) for row in x]
    return [f if f < 1 << 63 else None for f in found]


def _whitened(size: int, n: int, sums: list[int], mean: np.ndarray, project: np.ndarray, explained: np.ndarray, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = project.shape[1]
        for batch in batches:
            places, vectors = _rows_of(batch.column(1), size)
            x = whole_numbers(vectors)
            white = (x.astype(np.float64) - mean) @ project
            rows = len(places)
            columns = [
                batch.column(0).take(pa.array(np.repeat(places, count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * count, n, np.int64)), pa.array(_exact(size, n, sums, x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), count))),
                pa.array(white.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def blocks_of(good: DataFrame, size: int) -> DataFrame:
    """(n, x): the distinct vectors in blocks, written; the blocks of up to ``TASK`` vectors lie in one partition."""
    distinct = written(good.mapInArrow(_encoded(size), "x binary").distinct(), "distinct")
    tasks = max(1, -(-distinct.count() // TASK))
    return written(distinct.coalesce(tasks).mapInArrow(_blocked(size), "n long, x binary"), "whole")


def whitened(embeddings: DataFrame, *, components: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): every vector on the leading components.

    A component c becomes x = floor(64 * c) + 1,000,000; mean and covariance are those of the distinct x vectors, ``n`` of
    them.  ``deviation`` is the exact sum of (n * x - S)^2, NULL where a long cannot hold it; ``identity_error`` the largest
    entry of the whitened vectors' covariance minus the identity.  Rows whose vector is NULL or holds NULL or non-finite
    components are left out, and so are vectors of another length than most have (of equally many, the longest).  Rows that
    occur twice appear twice; a NULL id stays NULL.  Components without variance are left out: a single distinct vector,
    empty vectors and no rows give none.  Components beyond 2**56 count as 2**56.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
    good = rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    lengths = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = lengths["size"] if lengths else 0
    if not size:
        return spark.createDataFrame([], WHITE)
    centred = Centred(blocks_of(good.select("vector"), size), size)
    trace = float(centred.added(lambda c: np.array([(c * c).sum()]), (1,))[0])
    values, vectors = leading_pairs(centred.times, size, min(components, size)) if trace > 0 else (np.zeros(0), np.zeros((size, 0)))
    if not len(values):
        return spark.createDataFrame([], WHITE)
    project = vectors / np.sqrt(values)
    spread = centred.added(lambda c: (c @ project).T @ (c @ project), (len(values), len(values)))
    error = float(np.abs(spread - np.eye(len(values))).max())
    sums = [int(t) for t in centred.sums]
    return rows.mapInArrow(_whitened(size, centred.n, sums, centred.mean, project, values / trace, error), WHITE)
