"""Neighbours, density clusters, components, split tests against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tasksieve.operators import cluster as CL
from tasksieve.operators import neighbours as N
from tasksieve.operators.features import class_tfidf
from tasksieve.operators.topics import topic_coherence


def frame(spark, x, names=None):
    names = names or [f"{i:04d}" for i in range(len(x))]
    return spark.createDataFrame([(n, [float(v) for v in row]) for n, row in zip(names, x)], "task_id string, embedding array<double>")


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(160, 8)))
    x[40:90] = x[40]  # a group of copies holds a third of the rows
    return x


def brute_nearest(q, p, k):
    sims = np.round(q @ p.T, 9)
    return [[f"{j:04d}" for j in sorted(range(len(p)), key=lambda j: (-row[j], j))[:k]] for row in sims]


@pytest.mark.parametrize("small_rows, block_rows", [(10_000, 4096), (0, 16), (0, 7)])
def test_nearest_is_exact(spark, points, small_rows, block_rows):
    queries = frame(spark, points[:30], [f"q{i:03d}" for i in range(30)])
    got = N.nearest(queries, frame(spark, points), 5, small_rows=small_rows, block_rows=block_rows).orderBy("task_id", "rank").collect()
    want = brute_nearest(points[:30], points, 5)
    assert [[r.neighbour for r in got if r.task_id == f"q{i:03d}"] for i in range(30)] == want


def test_fewer_rows_than_k(spark, points):
    got = N.nearest(frame(spark, points[:2]), frame(spark, points[:3]), 5, small_rows=0, block_rows=2)
    assert got.count() == 6


@pytest.mark.parametrize("small_rows", [1000, 0])
def test_similar_pairs(spark, points, small_rows):
    few = unit(np.unique(points, axis=0))
    df = frame(spark, few)
    got = {(r.a, r.b) for r in N.similar_pairs(df, df, 0.4, "task_id", "embedding", small_rows=small_rows).collect()}
    sims = few @ few.T
    assert got == {(f"{i:04d}", f"{j:04d}") for i, j in zip(*np.nonzero(sims > 0.4))}


@pytest.mark.parametrize("small_rows", [1000, 0])
def test_similar_pairs_later_ids_in_slices(spark, points, small_rows, monkeypatch):
    monkeypatch.setattr(N, "SLICE_BYTES", 8 * 300)  # a few rows a slice
    df = frame(spark, points)  # with copies
    got = sorted((r.a, r.b, round(r.sim, 6)) for r in N.similar_pairs(df, df, 0.4, "task_id", "embedding", small_rows, later=True).collect())
    sims = points @ points.T
    assert got == [(f"{i:04d}", f"{j:04d}", round(sims[i, j], 6)) for i, j in zip(*np.nonzero(sims > 0.4)) if i < j]
    assert N.similar_pairs(df.limit(0), df, 0.4, "task_id", "embedding", small_rows, later=True).count() == 0


def test_blocked_neighbours_move_no_row_once_per_block(spark, points, capfd):
    """Packs meet in a cross join of stored tables: rows are packed once each, in packs that grow with the table."""
    got = N.nearest(frame(spark, points[:30]), frame(spark, points), 5, small_rows=0, block_rows=2)
    got.explain()
    plan = capfd.readouterr().out
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    cells = N._Cells(frame(spark, points).select("task_id", "embedding"), "task_id", "embedding", 2)
    packs = cells.packs.select("n", "c_task_id").collect()
    assert sorted(i for p in packs for i in p.c_task_id) == [f"{i:04d}" for i in range(160)] and max(p.n for p in packs) <= 3
    rows = spark.range(1000).select(F.col("id").alias("task_id"), F.array(F.col("id").cast("double")).alias("v"), F.lit(7).cast("bigint").alias("cell"))
    assert N._packed(rows, ["task_id"], "v", 1000, 4).agg(F.max("n"), F.sum("n")).first() == (16, 1000)


def test_a_task_reports_a_forest_not_its_links(spark):
    """400 rows within reach of each other in many small packs: links of a task are fewer than its rows."""
    x = np.random.default_rng(2).normal(0, 0.01, size=(400, 3))
    forest, rows = N._Forest([5, 2]), [N._Rows(p, x[p * 20:p * 20 + 20], {"pid": np.array([f"{p * 20 + i:04d}" for i in range(20)])}, np.arange(20)) for p in range(20)]
    met = 0
    for l in rows:
        for r in rows:
            u, v = forest.place(l), forest.place(r)
            if l.pack <= r.pack and not forest.joined(u, v, 400):
                met += 1
                forest.add(np.repeat(u, 20), np.tile(v, 20), np.full(400, 5))
    table = forest.table()
    assert len(table) == 399 and set(table["level"]) == {5} and met < 210
    unique, member = N.density_levels(frame(spark, x), 1.0, [2, 5], block_rows=20)
    assert member.count() == 800 and member.select("component").distinct().count() == 1


def brute_density(x, eps, min_samples, min_size):
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    near = d <= eps + 1e-9
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    current = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if label[j] < 0:
                    label[j] = current
                    stack += [m for m in np.flatnonzero(near[j] & core) if label[m] < 0]
            current += 1
    for i in np.flatnonzero(~core):
        options = np.flatnonzero(near[i] & core)
        if len(options):
            label[i] = label[min(options, key=lambda j: (round(d[i, j], 9), j))]
    sizes = np.bincount(label[label >= 0], minlength=current)
    return np.array([l if l >= 0 and sizes[l] >= min_size else -1 for l in label])


def groups(labels):
    out = {}
    for i, l in enumerate(labels):
        out.setdefault(l, set()).add(i)
    return {frozenset(v) for k, v in out.items() if k != -1}, out.get(-1, set())


@pytest.mark.parametrize("block_rows", [4096, 10])
def test_density_clusters(spark, block_rows):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.25, size=(40, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-4, 7, size=(25, 2))])
    x[:30] = x[0]
    got = {r.task_id: r.topic_id for r in N.density_cluster(frame(spark, x), 0.5, 4, 10, block_rows=block_rows).collect()}
    labels = [got[f"{i:04d}"] for i in range(len(x))]
    assert groups(labels) == groups(brute_density(x, 0.5, 4, 10))
    sizes = [labels.count(t) for t in range(max(labels) + 1)]
    assert sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("dims,block_rows", [(1, 7), (3, 16), (5, 4096)])
def test_levels_equal_single_clusterings(spark, dims, block_rows):
    """One neighbour join gives the clusters of every density; grids of one to three axes, cells cut in blocks, copies."""
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(c, 0.3, size=(40, dims)) for c in (0, 2, 5)] + [rng.uniform(-3, 8, size=(40, dims))])
    x[:25] = x[0]
    vectors = frame(spark, x)
    eps = 0.4 * dims**0.5
    unique, member = N.density_levels(vectors, eps, [1, 3, 9], block_rows=block_rows)
    for m in (1, 3, 9):
        got = {r.task_id: r.topic_id for r in N.topics_of_level(vectors, unique, member, m, 5).collect()}
        assert groups([got[f"{i:04d}"] for i in range(len(x))]) == groups(brute_density(x, eps, m, 5))


def test_grid_compares_touching_cells_only(spark):
    """Rows in a long line: the work is that of the neighbours, whatever the number of rows."""
    seen = []
    for n in (200, 2_000):
        rows = frame(spark, np.arange(n)[:, None] * [1.0, 0.0]).select(F.col("task_id").alias("pid"), F.col("embedding").alias("x"))
        grid = N._Grid(rows, "pid", "x", 1.5, 64)

        def compared(left, right):
            return pd.DataFrame({"pairs": [len(left) * len(right)]})

        seen.append(grid.join(rows, compared, "pairs bigint").agg(F.sum("pairs")).first()[0])
        assert grid.rows.select("cell").distinct().count() > n / 3
    assert seen[1] < 11 * seen[0]


def test_sweep_equals_each_clustering(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.2, size=(30, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-1, 5, size=(30, 2))])
    vectors = frame(spark, x)
    from tasksieve.operators.cluster import sweep_objective, sweep_params

    got = {(r.min_cluster_size, r.min_samples): r for r in sweep_params(vectors, 0.3, (2, 6), (2, 4)).collect()}
    assert len(got) == 4
    for (size, m), r in got.items():
        plain = sweep_objective(N.density_cluster(vectors, 0.3, m, size), vectors).first()
        assert r.topics == plain.topics and abs(r.outlier_rate - plain.outlier_rate) < 1e-12 and abs(r.objective - plain.objective) < 1e-9


def test_no_core_means_all_noise(spark):
    out = N.density_cluster(frame(spark, np.eye(6)), 0.1, 2, 2)
    assert {r.topic_id for r in out.collect()} == {-1} and out.count() == 6


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    got = {r.id: r.component for r in N.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[200] == 200


def test_split_finds_the_two_halves(spark):
    rng = np.random.default_rng(1)
    two = unit(np.concatenate([rng.normal([3, 0, 0], 0.2, (25, 3)), rng.normal([0, 3, 0], 0.2, (25, 3))]))
    one = unit(rng.normal([0, 0, 1], 1.0, (40, 3)))
    x = np.concatenate([two, one, unit(rng.normal(size=(5, 3)))])
    topic = [0] * 50 + [1] * 40 + [2] * 5
    names = [f"{i:04d}" for i in range(len(x))]
    assign = spark.createDataFrame(list(zip(names, topic)), "task_id string, topic_id bigint")
    docs = spark.createDataFrame([(n, "alpha alpha bravo" if i < 25 else "delta delta echo") for i, n in enumerate(names)], "task_id string, cleaned_text string")
    rows = {r.topic_id: r for r in CL.split_test(assign, frame(spark, x), docs).collect()}
    assert rows[0].split_recommended and rows[0].strength == "STRONG" and {rows[0].sub_a_count, rows[0].sub_b_count} == {25}
    assert {rows[0].sub_a_keywords.split(", ")[0], rows[0].sub_b_keywords.split(", ")[0]} == {"alpha", "delta"}
    assert rows[2].reason == "Too few docs" and not rows[2].split_recommended
    halves = {r.task_id: r.half for r in CL.halve_topics(assign.filter("topic_id = 0"), frame(spark, x)).collect()}
    assert len({halves[n] for n in names[:25]}) == 1 and halves[names[0]] != halves[names[30]]


def test_coherence_equals_the_pairs(spark):
    rng = np.random.default_rng(2)
    x = unit(rng.normal(size=(30, 5)))
    topic = [i % 4 for i in range(29)] + [9]
    assign = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(topic)], "task_id string, topic_id bigint")
    for r in topic_coherence(assign, frame(spark, x)).collect():
        part = x[[i for i, t in enumerate(topic) if t == r.topic_id]]
        sims = part @ part.T
        want = (sims.sum() - len(part)) / (len(part) * (len(part) - 1)) if len(part) > 1 else 0
        assert r.coherence == pytest.approx(want, abs=1e-9)


def test_objective(spark):
    x = frame(spark, np.repeat(np.eye(6), 5, axis=0))
    def objective(topics):
        assign = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(topics)], "task_id string, topic_id bigint")
        return CL.sweep_objective(assign, x).first().objective
    six = [i // 5 for i in range(30)]
    assert objective(six) == pytest.approx(1 - 14 * 0.01)
    assert objective([0] * 15 + [1] * 15) == -2.0
    assert objective([-1] * 6 + six[6:]) == pytest.approx(-1 + 0.1 - 0.2)


def test_resolutions_keep_ids(spark, points):
    out = CL.cluster_multi_resolution(frame(spark, points), {"fine": 6, "coarse": 2})
    sizes = {r.resolution: (r.n, r.k) for r in out.groupBy("resolution").agg(F.count_distinct("task_id").alias("n"), F.count_distinct("topic_id").alias("k")).collect()}
    assert sizes["fine"][0] == sizes["coarse"][0] == 160 and sizes["coarse"][1] <= 2
    assert out.count() == 320


def test_zero_shot_rest_is_numbered_after_the_seeds(spark):
    rng = np.random.default_rng(4)
    near = unit(rng.normal([5, 0, 0, 0], 0.2, (10, 4)))
    other = unit(rng.normal([0, 0, 5, 0], 0.2, (10, 4)))
    seeds = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0])], "seed_id bigint, embedding array<double>")
    out = {r.task_id: r.topic_id for r in CL.zero_shot_then_cluster(frame(spark, np.concatenate([near, other])), seeds, 0.5, 0.6, 3, 5).collect()}
    assert {out[f"{i:04d}"] for i in range(10)} == {0} and {out[f"{i:04d}"] for i in range(10, 20)} == {2}


def test_same_clusters_from_all_copies(spark):
    got = N.density_cluster(frame(spark, np.ones((50, 3))), 0.1, 3, 30)
    assert [r.topic_id for r in got.collect()] == [0] * 50


def test_best_topic_is_the_top_of_the_membership_table(spark):
    rng = np.random.default_rng(5)
    vec = frame(spark, np.vstack([rng.standard_normal((50, 4)), np.zeros((1, 4))]))
    same = [1.0, 0.0, 0.0, 0.0]
    cent = spark.createDataFrame([(3, same), (1, same), (2, [0.0, 1.0, 0.0, 0.0])], "topic_id bigint, centroid array<double>")
    want = {r.task_id: (r.best_topic, round(r.best_prob, 9)) for r in CL.best_membership(CL.soft_membership(vec, cent)).collect()}
    got = {r.task_id: (r.best_topic, round(r.best_prob, 9)) for r in CL.best_topic(vec, cent).collect()}
    assert got == want and all(t in (1, 2) for t, _ in got.values())
    assert CL.best_topic(vec, cent.limit(0)).count() == 0


def test_best_columns_with_ties():
    rng = np.random.default_rng(11)
    sims = rng.integers(0, 4, (50, 30)) / 4.0
    want = np.argsort(-sims, axis=1, kind="stable")
    for k in (1, 7, 30, 40):
        assert (N._best(np.arange(30), sims, k) == want[:, :k]).all()
    assert N._best(np.arange(0), np.zeros((3, 0)), 5).shape == (3, 0)


def test_nearest_in_slices(spark, points, monkeypatch):
    monkeypatch.setattr(N, "SLICE_BYTES", 8 * 160 * 7)
    left = frame(spark, points[:30]).toPandas()
    found = list(N._answers(left, np.arange(160), points, None, 5, "task_id", "embedding", None))
    assert [len(f) for f in found] == [35, 35, 35, 35, 10]
    got = [[f"{j:04d}" for j in np.concatenate([f["neighbour"] for f in found])[5 * i:5 * i + 5]] for i in range(30)]
    assert got == brute_nearest(points[:30], points, 5)


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr(N, "HUB_LINKS", 5)
    edges = [(0, i) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(139, 59), (200, 201), (300, 300)]
    got = {r.id: r.component for r in N.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**dict.fromkeys([*range(60), *range(100, 140)], 0), 200: 200, 201: 200, 300: 300}


def test_any_number_of_topics_in_blocks(spark):
    """Memberships, best topics, silhouettes and halves are the same however many centres a worker holds."""
    rng = np.random.default_rng(12)
    x, centres = rng.normal(size=(60, 6)), rng.normal(size=(41, 6))
    centres[7] = centres[3]  # equal topics tie
    vectors = frame(spark, x)
    topics = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "topic_id bigint, centroid array<double>")
    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T
    p = np.exp(sims) / np.exp(sims).sum(axis=1, keepdims=True)
    for block in (41, 9):
        got = {(r.task_id, r.topic_id): r.prob for r in CL.soft_membership(vectors, topics, block=block).collect()}
        assert len(got) == p.size and all(abs(got[f"{i:04d}", t] - p[i, t]) < 1e-12 for i in range(60) for t in range(41))
        best = {r.task_id: (r.best_topic, r.best_prob) for r in CL.best_topic(vectors, topics, block=block).collect()}
        assert [best[f"{i:04d}"][0] for i in range(60)] == np.argmax(np.round(p, 12), axis=1).tolist()
    assert CL.best_topic(vectors, topics.limit(0)).count() == 0
    assign = spark.createDataFrame([(f"{i:04d}", i % 7 if i < 59 else 99) for i in range(60)], "task_id string, topic_id int")
    whole = {r.task_id: r.silhouette for r in CL.silhouette_rows(assign, vectors).collect()}
    parts = {r.task_id: r.silhouette for r in CL.silhouette_rows(assign, vectors, block=2).collect()}
    assert whole["0059"] == 0 and all(abs(whole[i] - parts[i]) < 1e-12 for i in whole)
    halves = [{(r.task_id, r.half) for r in CL.halve_topics(assign, vectors, block=b).collect()} for b in (20, 3)]
    assert halves[0] == halves[1] and len(halves[0]) == 60


def test_fifty_thousand_centres(spark):
    centres = spark.range(50_000).selectExpr("id AS topic_id", "array(cos(id * 1e-4D), sin(id * 1e-4D)) AS centroid")
    angles = [0.00004, 1.23456, 4.99994]
    got = CL.best_topic(frame(spark, [[np.cos(a), np.sin(a)] for a in angles]), centres).collect()
    # probabilities tie at twelve places near the top; the smallest of those that tie is told
    assert len(got) == 3 and all(abs(r.best_topic * 1e-4 - a) < 0.02 for r, a in zip(sorted(got, key=lambda r: r.task_id), angles))


def test_representatives_are_filled_up(spark):
    from tasksieve.operators.cluster import representative_docs

    assign = spark.createDataFrame([(str(i), t) for i, t in enumerate([0, 0, 0, 0, 0, 1, 1, 2, -1])], "task_id string, topic_id int")
    vec = spark.createDataFrame([("0", [1.0, 0.0]), ("1", [0.0, 1.0]), ("2", [1.0, 0.1]), ("5", [1.0, 1.0])], "task_id string, embedding array<double>")
    names = ["far", "side", "far", "late", "later", "", "only", None, "out"]
    docs = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "task_id string, name string")
    got = {}
    for r in representative_docs(assign, vec, docs).orderBy("topic_id", "rank").collect():
        got.setdefault(r.topic_id, []).append((r.rank, r.task_id, r.name, r.sim is not None))
    assert got == {0: [(1, "2", "far", True), (2, "1", "side", True), (3, "3", "late", False)],
                   1: [(1, "6", "only", False), (2, None, "", False), (3, None, "", False)],
                   2: [(k, None, "", False) for k in (1, 2, 3)]}


def test_halves_equal_plain_2_means(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 4))
    topic = [i % 3 for i in range(90)]
    assign = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(topic)], "task_id string, topic_id bigint").repartition(5)
    got = {r.task_id: r.half for r in CL.halve_topics(assign, frame(spark, x)).collect()}
    for t in range(3):
        at = [i for i in range(90) if topic[i] == t]
        rows = x[at]
        far = rows[np.argmax(((rows - rows.mean(axis=0)) ** 2).sum(axis=1))]
        c = np.stack([far, rows[np.argmax(((rows - far) ** 2).sum(axis=1))]])
        for _ in range(100):
            d = ((rows[:, None, :] - c) ** 2).sum(axis=2)
            half = (d[:, 1] < d[:, 0]).astype(int)
            c = np.stack([rows[half == h].mean(axis=0) for h in (0, 1)])
        assert [got[f"{i:04d}"] for i in at] == half.tolist()


def test_vectors_of_a_topic_are_stored_as_bytes(spark):
    """A batch of vectors leaves as one row a topic, so a round of 2-means does not turn every vector into a list."""
    pdf = pd.DataFrame({"task_id": list("abcde"), "topic_id": [1, 2, 1, 1, 2], "x": [np.full(3, float(i)) for i in range(5)]})
    (out,) = list(CL._packed("task_id", "topic_id")([pdf, pdf.iloc[:0]]))
    assert out["topic_id"].tolist() == [1, 2] and out["ids"].tolist() == [["a", "c", "d"], ["b", "e"]]
    assert np.frombuffer(out["x"][0]).reshape(3, 3)[:, 0].tolist() == [0.0, 2.0, 3.0]


def test_discover_cuts_a_dealt_copy_of_the_texts(spark, monkeypatch):
    """The corpus is computed once; terms are cut from the stored copy, whose rows are spread over tasks."""
    from tasksieve.plans import corpus as plans

    cut = []
    monkeypatch.setattr(plans, "class_tfidf", lambda named, *a, **k: cut.append(named) or class_tfidf(named, *a, **k))

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text_of(task_id):
        seen.add(1)
        return "alpha bravo charlie " + task_id

    rng = np.random.default_rng(7)
    x = unit(rng.normal(size=(80, 4)))
    names = [f"{i:04d}" for i in range(80)]
    assign = spark.createDataFrame([(n, i % 2) for i, n in enumerate(names)], "task_id string, topic_id bigint")
    corpus = spark.range(80).repartition(1).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("task_id")).select(
        "task_id", text_of("task_id").alias("cleaned_text"), F.lit("General").alias("primary_platform"))
    out = plans.discover(corpus, frame(spark, x, names), assign, [], [])
    assert [(r.topic_id, r.doc_count) for r in out["final"].orderBy("topic_id").collect()] == [(0, 40), (1, 40)]
    assert seen.value == 80
    assert "text_of" not in cut[0]._jdf.queryExecution().analyzed().toString()
