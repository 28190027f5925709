"""Joins, top-k, numbering and counts that must hold when one key has most rows."""

import pytest
from pyspark.sql import functions as F

from tasksieve.operators.classify import label_position
from tasksieve.operators.dedup import dedup_keep_first, dup_count
from tasksieve.operators.features import group_terms
from tasksieve.session import checkpointed, join_unique, numbered, small_side, top_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, a third of them one text, another part in pairs."""
    return spark.range(3000).select(
        F.col("id").cast("string").alias("task_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("p"), (F.col("id") / 6).cast("int")))
        .otherwise(F.concat(F.lit("u"), F.col("id"))).alias("text"))


def test_counts_by_key(skewed):
    got = {r.task_id: r.dup_count for r in dup_count(skewed, "text").collect()}
    rows = skewed.collect()
    sizes = {}
    for r in rows:
        sizes[r.text] = sizes.get(r.text, 0) + 1
    assert got == {r.task_id: sizes[r.text] for r in rows}


@pytest.mark.parametrize("hot_keys", [0, 1, 5, 10_000])
def test_join_unique_equals_a_plain_join(spark, skewed, hot_keys):
    right = skewed.groupBy("text").agg(F.count("*").alias("n"), F.min("task_id").alias("low")).filter("n > 1")
    plain = {tuple(r) for r in skewed.join(right, "text", "left").select("task_id", "text", "n", "low").collect()}
    got = [tuple(r) for r in join_unique(skewed, right, "text", "n", max(hot_keys, 1)).select("task_id", "text", "n", "low").collect()]
    assert len(got) == 3000 and set(got) == plain


def test_keep_first(skewed):
    kept = dedup_keep_first(skewed, "text", F.col("task_id").cast("bigint"))
    rows = {r.text: r for r in kept.collect()}
    assert rows["hot"].task_id == "0" and rows["hot"].dup_count == 1000
    assert sum(r.dup_count for r in rows.values()) == 3000


def test_keep_first_of_ties_nulls_and_identical_rows(spark, capfd):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), ("a", None, "z"), (None, 5, "n"), (None, 4, "m"), ("", 9, "e"),
            ("k", None, "u"), ("k", None, "u"), ("k", None, "v")]
    df = spark.createDataFrame(rows, "text string, k bigint, more string")
    kept = dedup_keep_first(df, "text", F.col("k"))
    got = {r.text: r for r in kept.collect()}
    assert kept.count() == 4 and kept.columns == ["text", "k", "more", "dup_count"]
    assert (got["a"].k, got["a"].dup_count) == (1, 4) and got["a"].more in "xy"
    assert (got[None].k, got[None].more, got[None].dup_count) == (4, "m", 2)
    assert got[""].dup_count == 1 and got["k"].k is None and got["k"].dup_count == 3
    assert dedup_keep_first(df.limit(0), "text", F.col("k")).count() == 0
    kept.explain()
    assert "SortAggregate" not in capfd.readouterr().out


def test_top_per_group_limits_before_the_shuffle(skewed, capfd):
    top = top_per_group(skewed, ["text"], [F.col("task_id")], 2)
    assert top.groupBy("text").count().agg(F.max("count")).first()[0] == 2
    top.explain()
    plan = capfd.readouterr().out
    assert plan.count("WindowGroupLimit") == 4  # partial and final, of the slices and of the groups


@pytest.mark.parametrize("order", ["id", "text"])
def test_last_task_of_a_group_reads_slices_only(spark, order):
    """One group in 211 partitions: what is left of its slices is slices x k rows, and the result is the plain one."""
    one = spark.range(0, 5000, 1, 211).select(F.lit("g").alias("g"), "id", F.md5(F.col("id").cast("string")).alias("text"))
    got = top_per_group(one, ["g"], [F.col(order)], 3, slices=4).orderBy("rank").collect()
    assert [r.id for r in got] == [r.id for r in one.orderBy(order).limit(3).collect()] and [r.rank for r in got] == [1, 2, 3]
    slice_of = F.pmod(F.spark_partition_id(), F.lit(4))
    assert one.select(slice_of.alias("s")).distinct().count() == 4


def test_numbers_are_dense(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v")).repartition(7)
    rows = numbered(df, [F.col("v").desc()], "i").collect()
    assert {r.v: r.i for r in rows} == {v: 499 - v for v in range(500)}


def test_small_side_leaves_big_tables_alone(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    assert hinted(small_side(spark.range(10), 10)) and not hinted(small_side(spark.range(11), 10))


def test_positions_are_a_permutation(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("task_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    rows = label_position(df, "label").collect()
    for label in "ab":
        places = sorted(r.position for r in rows if r.label == label)
        assert places == list(range(1, len(places) + 1))


def test_written_steps_keep_rows_and_types(spark):
    df = spark.createDataFrame([("1", [1.0], None), ("2", [], "x")], "task_id string, v array<double>, s string")
    back = checkpointed(df)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.schema.simpleString() == df.schema.simpleString()


def test_top_per_group_in_two_levels(spark):
    """The last task of a group reads slices x k rows at most, whatever the number of tasks before."""
    from tasksieve.session import top_per_group

    rows = spark.range(0, 20_000, 1, 211).selectExpr("if(id % 10 < 7, 0, id % 5) AS g", "pmod(xxhash64(id), 500) AS v", "id", "id AS rank")
    plain = {}
    for g, v, i in rows.select("g", "v", "id").collect():
        plain.setdefault(g, []).append((v, i))
    for k, slices in ((3, 4), (1, 32), (7, 1)):
        top = top_per_group(rows, ["g"], [F.asc("v"), F.asc("id")], k, slices=slices)
        got = {}
        for r in top.orderBy("g", "rank").collect():
            got.setdefault(r["g"], []).append((r["v"], r["id"]))
            assert r["rank"] == len(got[r["g"]])
        assert got == {g: sorted(x)[:k] for g, x in plain.items()}
        before = top._jdf.queryExecution().executedPlan().toString()
        assert before.count("WindowGroupLimit") >= 4 and before.count("Exchange") == 2


@pytest.mark.parametrize("bins,few", [(1_024, 10_000), (4, 5), (2, 1)])
def test_medians_are_exact_on_raw_doubles(spark, bins, few):
    """One topic holds most rows; values on many scales, ties, single rows, nulls and NaN."""
    import random
    import statistics

    from tasksieve.operators.trends import confidence_by_topic, group_medians

    rng = random.Random(4)
    rows = [("hot", rng.random()) for _ in range(501)] + [("wide", 10.0 ** rng.uniform(-200, 3)) for _ in range(60)] + [("ties", rng.choice([0.25, 0.5])) for _ in range(40)]
    rows += [("one", 0.7), ("two", 0.1), ("two", 0.4), ("none", None), (None, 0.3), (None, 0.9), ("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "label string, confidence double")
    want = {}
    for g, v in rows:
        if v is not None and v == v:
            want.setdefault(g, []).append(v)
    got = {r.label: r.median for r in group_medians(df, "label", "confidence", bins, few).collect()}
    assert got == {g: pytest.approx(statistics.median(v), rel=1e-15) for g, v in want.items()}
    report = confidence_by_topic(df.filter("label not in ('hot')"), "label").collect()
    assert [r.mean_conf for r in report if r.label != "none"] == sorted(r.mean_conf for r in report if r.label != "none") and len(report) == 5


def test_terms_of_groups_in_bounded_parts(spark):
    """The parts follow the bytes of the texts, and an id with several texts counts once for a term."""
    rows = [(f"{i % 50:03d}", i % 2, f"alpha alpha bravo own{chr(97 + i % 26)}{chr(97 + i // 26)}" if i % 5 else "bravo") for i in range(60)] + [("900", 0, None), ("901", 0, "")]
    df = spark.createDataFrame(rows, "task_id string, topic_id int, text string").repartition(1)
    got = group_terms(df, "text", ["topic_id"], "task_id", (1, 2), size=40)
    total = sum(len(r[2] or "") for r in rows)
    assert got.rdd.getNumPartitions() == -(-total // 40) > spark.sparkContext.defaultParallelism
    occurrences, ids = {}, {}
    for name, group, text in rows:
        words = (text or "").split()
        for term in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
            occurrences[group, term] = occurrences.get((group, term), 0) + 1
            ids.setdefault((group, term), set()).add(name)
    assert {(r.topic_id, r.term): (r.tf, r.df) for r in got.collect()} == {k: (n, len(ids[k])) for k, n in occurrences.items()}
