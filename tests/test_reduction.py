"""Topic reduction against merges one by one."""

import numpy as np
import pytest

from tasksieve.operators import cluster as CL


def tables(spark, x, topics):
    ids = [f"{i:04d}" for i in range(len(x))]
    vec = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "task_id string, embedding array<double>")
    assign = spark.createDataFrame([(i, int(t)) for i, t in zip(ids, topics)], "task_id string, topic_id bigint")
    return assign, vec


def one_by_one(x, topics, n):
    """The definition: the closest pair of all, again and again."""
    groups = {int(t): [int((topics == t).sum()), x[topics == t].sum(0), [int(t)]] for t in np.unique(topics) if t != -1}
    steps = []
    while len(groups) > max(n, 1):
        def sim(a, b):
            u, v = groups[a][1], groups[b][1]
            lengths = np.linalg.norm(u) * np.linalg.norm(v)
            if lengths == 0:
                return float(not u.any() and not v.any())
            return float(u @ v / lengths)

        a, b = min(((a, b) for a in groups for b in groups if a < b), key=lambda p: (-round(sim(*p), 9), p))
        keep, drop = (a, b) if groups[a][0] >= groups[b][0] else (b, a)
        gone = groups.pop(drop)
        groups[keep] = [groups[keep][0] + gone[0], groups[keep][1] + gone[1], groups[keep][2] + gone[2]]
        steps.append((drop, keep))
    return {m: k for k, g in groups.items() for m in g[2]}, steps


def reduced(spark, x, topics, n, **more):
    assign, vec = tables(spark, x, topics)
    return {r.topic_id: r.merged_into for r in CL.reduce_topics(assign, vec, n, **more).collect()}


@pytest.mark.parametrize("spread, n, batch", [(0.3, 14, 512), (0.3, 35, 3)])
def test_merges_are_those_of_one_by_one(spark, spread, n, batch):
    rng = np.random.default_rng(11)
    homes = rng.normal(size=(8, 6))
    topics = np.r_[np.arange(40), rng.integers(0, 40, 120), -1, -1]
    x = homes[np.maximum(topics, 0) % 8] + spread * rng.normal(size=(40, 6))[np.maximum(topics, 0)] + 0.05 * rng.normal(size=(162, 6))
    assert reduced(spark, x, topics, n, batch=batch) == one_by_one(x, topics, n)[0]


def test_copies_ties_and_topics_without_direction(spark):
    x = np.array([[1, 0], [2, 0], [3, 0], [0, 1], [0, 1], [0, -1], [0, 0], [0, 0], [1, 1]], dtype=float)
    topics = np.array([5, 3, 9, 2, 7, 7, 8, 4, 1])
    assert reduced(spark, x, topics, 3) == one_by_one(x, topics, 3)[0]


def test_few_topics_and_none(spark):
    x = np.eye(3)
    assert reduced(spark, x, np.array([0, 1, 2]), 5) == {0: 0, 1: 1, 2: 2}
    assert reduced(spark, x, np.array([-1, -1, -1]), 2) == {}


def best_rows(x, topics):
    ids = [int(t) for t in np.unique(topics)]
    sums = np.stack([x[topics == t].sum(0) for t in ids])
    lengths = np.linalg.norm(sums, axis=1)
    sims = np.round(sums @ sums.T / np.outer(lengths, lengths), 9)
    rows = []
    for i, t in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], j))
        rows.append((t, lengths[i], ids[order[0]], sims[i, order[0]], sims[i, order[1]]))
    return sorted(rows, key=lambda r: (-r[3], min(r[0], r[2]), max(r[0], r[2]), r[0]))


@pytest.mark.parametrize("seed", range(12))
def test_a_round_takes_only_what_comes_next(seed):
    rng = np.random.default_rng(seed)
    topics = np.arange(60)
    x = rng.normal(size=(20, 5 + seed))[topics // 3] + 10.0 ** -(seed % 4) * rng.normal(size=(60, 5 + seed))
    steps = one_by_one(x, topics, 2)[1]
    rows = best_rows(x, topics)
    for cut in (2, 9, 60):
        pairs = CL.next_merges(rows[:cut], 50)
        assert 1 <= len(pairs) <= cut
        assert [set(p) for p in pairs] == [set(s) for s in steps[:len(pairs)]]
    assert len(CL.next_merges(rows, 1)) == 1


def test_tight_groups_need_few_rounds():
    rng = np.random.default_rng(2)
    topics = np.arange(200)
    x = rng.normal(size=(100, 40))[topics // 2] + 1e-3 * rng.normal(size=(200, 40))
    assert len(CL.next_merges(best_rows(x, topics), 100)) > 50
