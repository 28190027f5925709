"""Embedding whitening: covariance by Spark, its eigenvectors by spectral divide and conquer with QDWH polar factors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasksieve.session import checkpointed

#: x = floor(SCALE * c) + OFFSET; larger entries than LIMIT / SCALE count as that, so that x stays a whole number in double precision.
SCALE, OFFSET, LIMIT = 64, 1_000_000, 1 << 52
COMPONENTS = 16
#: Dimensions that are handled: one matrix of 8 x DIMS x DIMS bytes is on the driver.
DIMS = 4_096
#: Partial sums of this many tasks at most meet in one group before the last sum.
FAN_IN = 64
EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps.

    Each step is a rational function of the matrix with weights that follow from a lower bound of its
    singular values, which reaches 1 in about six steps; the first steps go through a QR factorisation, the later,
    well-conditioned ones through a Cholesky factorisation.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a, 1), np.finfo(np.float64).tiny)
    low = 1e-17
    for _ in range(rounds):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        w = np.sqrt(1 + d)
        alpha = w + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * w)) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        if gamma > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(n)]))
            new = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * q[:n] @ q[n:].T
        else:
            half = np.linalg.cholesky(np.eye(n) + gamma * x.T @ x)
            new = beta / gamma * x + (alpha - beta / gamma) * np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (alpha + beta * square) / (1 + gamma * square))
        if low > 1 - 4 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def _divided(a: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Columns that span the eigenvectors of a symmetric matrix, one each; ``scale`` is the norm of the whole matrix."""
    n = len(a)
    off = a - np.diag(np.diag(a))
    if n == 1 or np.linalg.norm(off) <= EPS * scale:
        return np.eye(n)
    diagonal, reach = np.diag(a), np.abs(off).sum(axis=1)
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    order = np.sort(diagonal)
    gaps = np.diff(order) * np.minimum(np.arange(1, n), np.arange(n - 1, 0, -1))  # a wide gap near the middle
    at = int(np.argmax(gaps))
    shift = (order[at] + order[at + 1]) / 2
    while high - low > 4 * EPS * scale:
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(np.rint(np.trace(projector)))
        if 0 < rank < n:
            # the projector's range from a random start, twice, and the rest of the space from the full factor
            q, _ = np.linalg.qr(projector @ rng.standard_normal((n, rank)))
            q, _ = np.linalg.qr(projector @ q, mode="complete")
            above, below = q[:, :rank], q[:, rank:]
            if np.linalg.norm(below.T @ a @ above) <= 64 * n * EPS * scale:
                parts = [_divided((b.T @ a @ b + (b.T @ a @ b).T) / 2, scale, rng) for b in (above, below)]
                return np.hstack([above @ parts[0], below @ parts[1]])
            # the shift is too close to an eigenvalue for a clean cut: take another one
            shift = low + (high - low) * rng.uniform(0.25, 0.75)
        elif rank == 0:
            high = min(high, shift)
            shift = (low + high) / 2
        else:
            low = max(low, shift)
            shift = (low + high) / 2
    return np.eye(n)  # all eigenvalues are the same to working precision


def eigen(a: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix.

    The polar factor of the shifted matrix gives the projector on the eigenvectors above the shift; both
    invariant subspaces are divided in the same way until single vectors are left.
    """
    a = (a + a.T) / 2
    scale = float(np.linalg.norm(a))
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    q = _divided(a, scale, np.random.default_rng(seed))
    q, r = np.linalg.qr(q)
    value = np.einsum("ij,ij->j", q, a @ q)
    order = np.argsort(-value, kind="stable")
    return value[order], q[:, order]


def whole_vectors(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """``(key, x)`` of the rows whose vector is whole, and the number of dimensions.

    Dropped are vectors that are null, empty, or hold null or non-finite entries, and those of another length than
    most whole vectors have (of equally common lengths the larger one).  ``x`` holds the entries as whole numbers.
    """
    c = F.col(f"`{vector}`").cast("array<double>")
    finite = F.size(c) > 0
    finite &= F.forall(c, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    told = rows.select(F.col(f"`{id}`").alias("key"), c.alias("c")).filter(F.coalesce(finite, F.lit(False)))
    most = told.groupBy(F.size("c").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        return told.select("key", F.col("c").cast("array<bigint>").alias("x")), 0
    if most["dims"] > DIMS:
        raise ValueError(f"vectors of {most['dims']} dimensions: {DIMS} at most")
    x = F.transform("c", lambda v: F.floor(F.least(F.greatest(v * SCALE, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))) + F.lit(OFFSET).cast("bigint"))
    return told.filter(F.size("c") == most["dims"]).select("key", x.alias("x")), most["dims"]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Moments:
    """Number, sums and centre of the distinct vectors: whole numbers of any size, and the mean split in a whole part and a rest."""

    def __init__(self, fit: DataFrame, dims: int):
        sums = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("s")).collect()  # one row a dimension
        self.n = fit.count()
        self.sums = [0] * dims
        for k, s in sums:
            self.sums[k] = int(s)
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.left = [s - int(w) * self.n for s, w in zip(self.sums, self.whole)]
        self.rest = np.array([x / self.n for x in self.left])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part of the mean is taken off in whole numbers."""
        return (x - self.whole).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S) squared, exact; null where a long can't hold it."""
        near = x - self.whole
        bound = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if bound * bound * max(1, x.shape[1]) < 1 << 63:
            apart = near * self.n - np.array(self.left, np.int64)
            return (apart * apart).sum(axis=1).tolist()
        out = []
        for row in near.tolist():
            total = sum((v * self.n - r) ** 2 for v, r in zip(row, self.left))
            out.append(total if total < 1 << 63 else None)
        return out


def products(fit: DataFrame, dims: int, shaped) -> np.ndarray:
    """The sum of the outer products of ``shaped(x)`` over all distinct vectors, centred before multiplying.

    A task adds up its own rows to one matrix; matrices of up to ``FAN_IN`` tasks are added together by a task, and only
    the last of these sums reach the driver.
    """
    def add(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = shaped(_matrix(batch.column(0), dims))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def sum_up(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0):
                part = np.frombuffer(raw.as_py())
                total = part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = checkpointed(fit.select("x").mapInArrow(add, "part binary"))
    left = parts.count()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = checkpointed(parts.repartition(left).mapInArrow(sum_up, "part binary"))
    found = [np.frombuffer(r["part"]) for r in parts.collect()]  # FAN_IN matrices at most
    found.sort(key=lambda m: m.tobytes())  # the order in which tasks end has no say
    total = sum(found)
    side = int(round(len(total) ** 0.5))
    return total.reshape(side, side)


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per whole vector and component: ``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    The mean and the covariance come from each distinct vector once.  Components are its eigenvectors by falling
    eigenvalue; ``whitened`` is the centred vector's length along one, over the root of the eigenvalue, so that over the
    distinct vectors all have variance 1 and no covariance; ``identity_error`` is how far that is missed, measured on the written
    vectors.  Components without variance (eigenvalues below rounding) can't be whitened and have no rows, so vectors
    that are all equal, or a single one, give an empty result.

    Dropped vectors are those of ``whole_vectors``; repeated rows each have their rows, null ids stay null, an empty table gives an
    empty result, further columns aren't looked at.  Entries beyond 2^52 / 64 count as that.  ``deviation`` is null
    where it does not fit a long.  Beyond the vectors only the mean, the eigenvectors of up to ``DIMS`` dimensions and one
    matrix for each of ``FAN_IN`` groups of tasks are on the driver, whatever the number of rows.
    """
    kept, dims = whole_vectors(rows, id, vector)
    kind = kept.schema["key"].dataType.simpleString()
    schema = f"key {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not dims:
        return kept.sparkSession.createDataFrame([], schema)
    fit = checkpointed(kept.select("x").distinct())
    moments = Moments(fit, dims)
    covariance = products(fit, dims, moments.centred) / moments.n
    value, axes = eigen(covariance)
    used = int((value[:components] > 4 * dims * EPS * max(value[0], 0)).sum()) if value[0] > 0 else 0
    if not used:
        return kept.sparkSession.createDataFrame([], schema)
    turn = axes[:, :used] / np.sqrt(value[:used])

    def whitened(x: np.ndarray) -> np.ndarray:
        return moments.centred(x) @ turn

    error = float(np.abs(products(fit, dims, whitened) / moments.n - np.eye(used)).max())
    explained = value[:used] / np.trace(covariance)

    def apply(batches):
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                x = _matrix(part.column(1), dims)
                y = whitened(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * used), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(moments.deviation(x), pa.int64()), flat], names=["key", "deviation", "all"])

    each = kept.mapInArrow(apply, f"key {kind}, deviation bigint, all array<double>").select("key", "deviation", F.posexplode("all").alias("k", "whitened"))
    shares = F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("k") + 1)
    return each.select("key", (F.col("k") + 1).alias("component"), F.lit(moments.n).cast("bigint").alias("n"), "deviation", "whitened",
                       shares.alias("explained"), F.lit(error).alias("identity_error"))
