"""Whitening against numpy's eigenvectors and whole-number sums."""

import math

import numpy as np
import pytest

from tasksieve.llm import whitening
from tasksieve.llm.queries import QUERIES
from tasksieve.llm.whitening import eigen, polar, whiten


def plain(rows, components=16):
    """rows: (id, vector) -> n, {id: deviation}, eigenvalues, vectors, whitened of every row, trace."""
    whole = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in whole]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    centre = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in fit])
    cov = centre.T @ centre / n
    value, axes = np.linalg.eigh(cov)
    value, axes = value[::-1][:components], axes[:, ::-1][:, :components]
    y = np.array([[(n * a - s) / n for a, s in zip(row, sums)] for row in x]) @ axes / np.sqrt(value)
    return [i for i, _ in whole], n, deviation, value / np.trace(cov), y


def check(df, rows, components=16):
    ids, n, deviation, explained, y = plain(rows, components)
    got = sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[0]), r[1]))
    k = y.shape[1]
    assert len(got) == len(ids) * k and all(r[2] == n for r in got)
    signs = {}
    by_id = {}
    for row in got:
        by_id.setdefault(row[0], []).append(row)
    want = {}
    for i, d, row in zip(ids, deviation, y):
        want.setdefault(i, []).append((d, row))
    for i, many in want.items():
        assert sorted({d for d, _ in many}) == sorted({r[3] for r in by_id[i]})
        if len(many) == 1:
            for r, w in zip(by_id[i], many[0][1]):
                if abs(w) > 1e-6:
                    signs.setdefault(r[1], set()).add(np.sign(r[4] / w))
                assert abs(abs(r[4]) - abs(w)) < 1e-7
    assert all(len(s) == 1 for s in signs.values())
    assert all(abs(r[5] / explained[r[1] - 1] - 1) < 1e-9 and r[6] < 1e-9 for r in got)


def test_query_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op13_embedding_whitening"](spark, folder).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"), rows)


@pytest.mark.parametrize("n,spread", [(1, "one"), (2, "wide"), (33, "wide"), (64, "even"), (40, "equal"), (24, "clusters"), (30, "low rank"), (5, "zero")])
def test_eigen(n, spread):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    value = {"one": [3.0], "wide": 10.0 ** rng.uniform(-9, 3, n), "even": np.linspace(1, 2, n), "equal": np.full(n, 2.5), "clusters": np.repeat([1.0, 1 + 1e-13, 5.0, 5.0], n // 4),
             "low rank": np.r_[np.ones(n // 3) * 4, np.zeros(n - n // 3)], "zero": np.zeros(n)}[spread]
    a = (q * value) @ q.T
    a = (a + a.T) / 2
    got, axes = eigen(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.allclose(got, np.sort(value)[::-1], atol=1e-12 * size)
    assert np.linalg.norm(axes.T @ axes - np.eye(n)) < 1e-12 * n
    assert np.linalg.norm(a @ axes - axes * got) < 1e-12 * n * size


def test_polar():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    value, q = np.linalg.eigh(a)
    assert np.allclose(polar(a), (q * np.sign(value)) @ q.T, atol=1e-12)


def test_copies_count_once(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((60, 5)) * [9, 4, 2, 1, 0.5]).tolist()
    rows = [(k, v) for k, v in enumerate(base)] + [(100 + k, base[7]) for k in range(50)] + [(100, base[8]), (200, [c + 1e-9 if math.floor(64 * c) == math.floor(64 * (c + 1e-9)) else c for c in base[9]])]
    check(whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(9)), rows)


def test_partial_sums_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = [(k, v) for k, v in enumerate(np.random.default_rng(4).standard_normal((80, 3)).tolist())]
    check(whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(7), components=2), rows, 2)


def test_odd_rows(spark):
    good = [(k, v) for k, v in enumerate((np.random.default_rng(5).standard_normal((30, 4)) * 3).tolist())]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0]), (53, [1.0, float("nan"), 0.0, 0.0]), (54, [float("inf"), 0.0, 0.0, 0.0]), (55, [1.0, 2.0]), (56, [-float("inf")] * 4)]
    rows = good + [(None, good[0][1]), (3, good[4][1])]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows + bad], "vec_id bigint, embedding array<double>, whitened double, component string")
    check(whiten(df), rows)
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.filter("vec_id = 5")).count() == 0  # a single vector has no variance
    flat = spark.createDataFrame([(k, [float(k), 2.0, float(k)]) for k in range(9)], "vec_id bigint, embedding array<double>")
    assert whiten(flat).select("component").distinct().count() == 1  # one direction only


def test_large_sums_are_exact(spark):
    rows = [(k, [k * 3e7, -k * 2e8, 5.0]) for k in range(40)] + [(99, [1e300, 0.0, 1.0])]
    got = {r["key"]: r["deviation"] for r in whiten(spark.createDataFrame(rows[:-1], "vec_id bigint, embedding array<double>")).collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows[:-1]]
    sums = [sum(c) for c in zip(*x)]
    want = [sum((40 * a - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert [got[k] for k in range(40)] == [w if w < 1 << 63 else None for w in want] and None in got.values()
    assert whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).filter("key = 99").count() > 0
