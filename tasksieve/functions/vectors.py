"""Vector arithmetic.

Rows of ``array<float>`` are turned into matrices inside Arrow batches, so that
dot products run as one numpy call per batch instead of one lambda per element.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


@F.pandas_udf(DoubleType())
def dot(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", matrix(a), matrix(b)) if len(a) else [], dtype="float64")


@F.pandas_udf(DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of two vector columns; 0 where a vector is zero."""
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = matrix(a), matrix(b)
    norms = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
    return pd.Series(np.divide(np.einsum("ij,ij->i", x, y), norms, out=np.zeros(len(x)), where=norms > 0))


@F.pandas_udf(ArrayType(DoubleType()))
def unit(a: pd.Series) -> pd.Series:
    """L2-normalised vectors; a zero vector stays zero."""
    if not len(a):
        return pd.Series([], dtype="object")
    x = matrix(a)
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return pd.Series(list(np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)))


def vector_sum(df: DataFrame, keys: list[str], vector: str = "embedding", weight: str | None = None) -> DataFrame:
    """Per group: ``n`` rows and the element-wise sum of their vectors.

    One row per group and batch leaves the map side: batches are summed with
    numpy before the shuffle, which only carries these partial sums.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(batches):
        sums: dict[tuple, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf[vector])
            w = pdf[weight].to_numpy(dtype=np.float64) if weight else np.ones(len(pdf))
            codes, groups = pd.factorize(pd.MultiIndex.from_frame(pdf[keys])) if keys else (
                np.zeros(len(pdf), dtype=int), [()])
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0])
            totals = np.add.reduceat(x[order] * w[order, None], starts, axis=0)
            counts = np.add.reduceat(w[order], starts)
            for group, count, total in zip(groups, counts, totals):
                kept = sums.setdefault(tuple(group), [0.0, 0.0])
                kept[0] += count
                kept[1] = kept[1] + total
            if len(sums) > 50_000:  # many groups: hand over what is there and start again
                yield _partial_rows(sums, keys)
                sums = {}
        if sums:
            yield _partial_rows(sums, keys)

    columns = keys + [vector] + ([weight] if weight else [])
    partials = df.select(*columns).mapInPandas(
        partial, ", ".join(filter(None, [fields, "n double", "total array<double>"])))
    elements = partials.select(*keys, "n", F.posexplode("total").alias("pos", "x"))
    # Two small aggregations: per element, then the elements of a group in order.
    summed = elements.groupBy(*keys, "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return summed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("total"))


def _partial_rows(sums: dict, keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(list(sums), columns=keys) if keys else pd.DataFrame(index=range(len(sums)))
    out["n"] = [v[0] for v in sums.values()]
    out["total"] = [v[1] for v in sums.values()]
    return out


def mean_of(total: Column, n: Column) -> Column:
    return F.transform(total, lambda x: x / n)


def norm2(c: Column) -> Column:
    """Squared length of a (small number of) vectors, as an expression."""
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
