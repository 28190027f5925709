"""Multinomial logistic regression on packed counts, by Newton steps.

The loss is the one of MLlib without standardization: the weighted mean of the losses plus ``reg / 2`` times the squares of the
coefficients, intercepts left out.  It has one minimum, in which coefficients and intercepts sum to 0 over the classes.  A Newton step is found by
conjugate gradients, so it takes a few passes over the rows where steps of first order take hundreds; the product
of the curvature and a direction costs as much as a gradient.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tasksieve.operators.features import FeaturePack, one_by_one

#: Passes for a step at most, and how much of the gradient a step may leave.
STEP_PASSES, STEP_REST = 200, 0.3
#: Tasks whose sums the driver adds up itself.
DRIVER_SUMS = 16


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive parts, 0 for empty ones."""
    starts = np.r_[0, ends[:-1]]
    some = ends > starts
    out = np.zeros(len(ends))
    if some.any():
        out[some] = np.add.reduceat(x, starts[some])
    return out


def _scores(p: FeaturePack, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores of the classes; those of the last follow, as all of them sum to 0."""
    z = np.empty((len(b), p.n))
    for k in range(len(b) - 1):
        x = w[k].take(p.at)
        x *= p.damped
        z[k] = _sums(x, p.ends) * p.scale + b[k]
    z[-1] = -z[:-1].sum(axis=0)
    return z


def _add_terms(total: np.ndarray, p: FeaturePack, rows: np.ndarray, damped: np.ndarray) -> None:
    x = rows.take(p.by_term)
    x *= damped
    total[p.terms] += _sums(x, p.term_ends)


class _Loss:
    """Sums over all rows: the loss with its gradient and the diagonal of its curvature, or the curvature times a direction."""

    def __init__(self, packs: DataFrame, label: str, classes: list[str], weights: np.ndarray, idf: np.ndarray, reg: float):
        self.context = packs.sparkSession.sparkContext
        column = f"c_{label}"

        def rows(batches):
            for batch in batches:
                names = pa.array(classes, pa.string())
                for i, row in enumerate(batch.drop_columns([column]).to_pylist()):
                    of = pc.index_in(batch.column(batch.schema.get_field_index(column))[i].values, value_set=names)
                    y = pc.fill_null(of, -1).to_numpy(zero_copy_only=False).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(row | {"y": y.tobytes()})], pa.binary())], ["row"])

        # kept as the bytes that tasks read, as every pass reads them all
        kept = one_by_one(packs).coalesce(self.context.defaultParallelism).mapInArrow(rows, "row binary")
        self.rows = kept.rdd.map(lambda r: bytes(r["row"])).persist(StorageLevel.MEMORY_AND_DISK)
        self.classes, self.weights, self.idf, self.reg = classes, weights, idf, reg
        self.shape, self.passes = (len(classes), len(idf) + 1), 0

    def _pass(self, at: np.ndarray, along: np.ndarray | None) -> np.ndarray:
        self.passes += 1
        scaled = [None if t is None else np.ascontiguousarray(np.c_[t[:, :-1] * self.idf, t[:, -1]]) for t in (at, along)]
        shared = self.context.broadcast((*scaled, self.weights))
        k, v = self.shape

        def run(rows):
            at, along, weights = shared.value
            w, b = np.ascontiguousarray(at[:, :-1]), at[:, -1]
            if along is not None:
                along_w, along_b = np.ascontiguousarray(along[:, :-1]), along[:, -1]
            total = np.zeros((k + 1, v))  # sums of the classes but the last, of the curvature, then of loss and weights
            for row in map(pickle.loads, rows):
                p, y = FeaturePack(row), np.frombuffer(row["y"], dtype=np.int32).astype(np.intp)
                a = np.where(y >= 0, weights[y], 0.0)
                z = _scores(p, w, b)
                z -= z.max(axis=0)
                e = np.exp(z)
                e_sum = e.sum(axis=0)
                q = e / e_sum
                if along is None:
                    own = np.arange(p.n)
                    total[k, 0] += a @ (np.log(e_sum) - z[y, own])
                    total[k, 1] += a.sum()
                    bend = a * (q * (1 - q)).mean(axis=0)
                    _add_terms(total[k - 1, :-1], p, bend * p.scale ** 2, p.by_damped ** 2)
                    total[k - 1, -1] += bend.sum()
                    q[y, own] -= 1
                    r = q * a
                else:
                    u = _scores(p, along_w, along_b)
                    r = q * (u - (q * u).sum(axis=0)) * a
                for c in range(k - 1):
                    _add_terms(total[c, :-1], p, r[c] * p.scale, p.by_damped)
                    total[c, -1] += r[c].sum()
            yield total

        sums = self.rows.mapPartitions(run)
        total = sums.treeReduce(np.add) if self.rows.getNumPartitions() > DRIVER_SUMS else sum(sums.collect(), np.zeros((k + 1, v)))
        shared.unpersist()
        return total

    def _whole(self, sums: np.ndarray) -> np.ndarray:
        """Of all classes, idf included."""
        some = sums[:len(self.classes) - 1]
        every = np.r_[some, -some.sum(axis=0, keepdims=True)] / self.weight
        every[:, :-1] *= self.idf
        return every

    def at(self, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        sums = self._pass(t, None)
        k = len(self.classes)
        loss, self.weight = sums[k, 0], sums[k, 1]
        bend = sums[k - 1] / self.weight
        bend[:-1] = bend[:-1] * self.idf ** 2 + self.reg
        bend[-1] = max(bend[-1], 1e-12)
        gradient = self._whole(sums)
        gradient[:, :-1] += self.reg * t[:, :-1]
        return loss / self.weight + self.reg / 2 * float((t[:, :-1] ** 2).sum()), gradient, bend

    def curved(self, t: np.ndarray, along: np.ndarray) -> np.ndarray:
        out = self._whole(self._pass(t, along))
        out[:, :-1] += self.reg * along[:, :-1]
        return out


def _newton_step(loss: _Loss, t: np.ndarray, gradient: np.ndarray, bend: np.ndarray, rest: float) -> np.ndarray:
    """Conjugate gradients, scaled by the curvature of each term, until ``rest`` of the gradient is left."""
    step, left = np.zeros_like(t), -gradient
    scaled = left / bend
    along, size = scaled, float((left * scaled).sum())
    first = size
    for _ in range(STEP_PASSES):
        curved = loss.curved(t, along)
        length = size / float((along * curved).sum())
        step = step + length * along
        left = left - length * curved
        scaled = left / bend
        before, size = size, float((left * scaled).sum())
        if size <= rest ** 2 * first:
            break
        along = scaled + size / before * along
    return step


def fit(packs: DataFrame, label: str, classes: list[str], weights: list[float], idf: np.ndarray, reg: float, tol: float = 1e-6,
        max_iter: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (class by term) and intercepts at the minimum.

    ``packs`` are of ``feature_packs`` with a column ``label``; rows of other labels than ``classes`` do not count.  Steps end as MLlib's
    do, when the loss falls by less than ``tol`` times the first loss (MLlib: in ten steps, here in one), or after ``max_iter`` of them.
    """
    loss = _Loss(packs, label, classes, np.array(weights, dtype=np.float64), idf, reg)
    t = np.zeros(loss.shape)
    now, gradient, bend = loss.at(t)
    least = tol * now
    for _ in range(max_iter):
        step = _newton_step(loss, t, gradient, bend, STEP_REST)
        slope = float((gradient * step).sum())
        share, there = 1.0, loss.at(t + step)
        while there[0] > now + 1e-4 * share * slope and share > 1e-6:
            share /= 2
            there = loss.at(t + share * step)
        if there[0] >= now:
            break
        before = now
        t, (now, gradient, bend) = t + share * step, there
        if before - now <= least:
            break
    loss.rows.unpersist()
    return t[:, :-1], t[:, -1]
