"""Embedding near-duplicates against brute force."""

import numpy as np
import pytest

from tasksieve.llm.queries import QUERIES
from tasksieve.llm.vectors import embedding_groups


def plain(rows, threshold=0.98):
    """rows: (id, vector or None, label or None) -> {index: (links, component)}."""
    n = len(rows)
    link = np.zeros((n, n), bool)
    by_label = {}
    for k, (_, v, g) in enumerate(rows):
        if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by_label.setdefault((g, len(v)), []).append(k)
    for at in by_label.values():
        x = np.array([rows[k][1] for k in at], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        link[np.ix_(at, at)] = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    head = list(range(n))
    for i in range(n):
        todo, seen = [i], {i}
        while todo:
            for j in np.flatnonzero(link[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        known = [rows[k][0] for k in seen if rows[k][0] is not None]
        head[i] = min(known) if known else None
    return [(rows[k][0], int(link[k].sum()), head[k], rows[k][0] == head[k]) for k in range(n)]


def collected(df):
    return sorted(((r["key"], r["n_links"], r["component"], r["kept"]) for r in df.collect()), key=str)


def test_query_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op5_embedding_dedup"](spark, folder).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == sorted(plain(rows), key=str)


@pytest.mark.parametrize("block", [1024, 5])
def test_families_of_near_copies(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    for family in range(6):
        centre = rng.standard_normal(16)
        for _ in range(25):
            rows.append((len(rows), (centre + 0.12 * rng.standard_normal(16)).tolist(), family % 2))
    rows += [(len(rows) + k, rows[3][1], rows[3][2]) for k in range(30)] + [(500, [2 * v for v in rows[3][1]], rows[3][2])]
    got = embedding_groups(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), block=block)
    assert collected(got) == sorted(plain(rows), key=str)


def test_odd_rows(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one, 1), (1, one, 1), (2, None, 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 0.0], 1), (5, [float("nan"), 1.0, 0.0], 1), (6, one, None),
            (7, [1e300, 0.0, 0.0], 1), (8, [], 1), (None, one, 1), (None, [0.0, 1.0, 0.0], 2), (9, [1.0, 0.0], 1), (10, [1e-300, -0.0, 0.0], 1), (11, [float("inf"), 0.0, 0.0], 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, label int, cls int, component string")
    got = collected(embedding_groups(docs))
    want = {i: (n, c) for i, n, c in [(1, 4, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 4, 1), (8, 0, 8), (9, 0, 9), (10, 4, 1), (11, 0, 11)]}
    assert len(got) == len(rows) and all(want[k] == (n, c) for k, n, c, _ in got if k is not None)
    assert sorted((n, c) for k, n, c, _ in got if k is None) == [(0, None), (4, 1)] or sorted(((n, str(c)) for k, n, c, _ in got if k is None)) == [(0, "None"), (4, "1")]
    assert embedding_groups(docs.limit(0)).count() == 0
