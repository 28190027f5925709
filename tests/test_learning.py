"""Features, classifiers, scoring and streams on small literal data."""

import json
import math
import re
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasksieve.operators import classify as CF
from tasksieve.operators import features as FE
from tasksieve.session import shared_folder
from tasksieve.sources import tables as S
from tasksieve.streaming import jobs

TEXTS = ["open new account for client", "new account setup request", "account opened new today", "billing invoice sent late",
         "invoice for billing period", "late invoice and billing question", "café account", "cafe invoice"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(str(i), t, "account" if "account" in t else "invoice") for i, t in enumerate(TEXTS)],
                                 "task_id string, cleaned_text string, label string")


def brute_tfidf(texts, min_df=2):
    rows = []
    for t in texts:
        w = re.findall(r"\b[a-z][a-z0-9\-]{1,}\b", t.replace("é", "e"))
        rows.append(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = {}
    for r in rows:
        for g in set(r):
            df[g] = df.get(g, 0) + 1
    out = {}
    for i, r in enumerate(rows):
        w = {g: (1 + math.log(r.count(g))) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g in set(r) if df[g] >= min_df}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(str(i), g): v / norm for g, v in w.items()})
    return out


def test_tfidf_table(docs):
    got = {(r.task_id, r.term): r.weight for r in FE.tfidf_features(docs, "cleaned_text").collect()}
    want = brute_tfidf(TEXTS)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_tfidf_stages_give_the_same_weights(docs):
    ready = CF.tfidf_input(docs)
    model = FE.fit_tfidf(ready, "cleaned_text")
    vocabulary = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    got = {}
    for r in model.transform(ready).select("task_id", "features").collect():
        got.update({(r.task_id, vocabulary[i]): v for i, v in zip(r.features.indices, r.features.values)})
    want = brute_tfidf(TEXTS)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_count_model_drops_stop_words_before_pairs(docs):
    model = FE.count_vector_model("cleaned_text", stop=["for", "and"]).fit(docs)
    terms = model.stages[-1].vocabulary
    assert "new account" in terms and not any("for" in t.split() for t in terms)


def test_vocabulary_limit_keeps_the_most_frequent(docs):
    kept = {r.term for r in FE.tfidf_features(docs, "cleaned_text", vocab=2).select("term").distinct().collect()}
    assert kept == {"account", "invoice"}


def test_encoder_gives_unit_vectors_and_keeps_ids(docs):
    rows = FE.embed_texts(docs, "cleaned_text").collect()
    assert {r.task_id for r in rows} == {str(i) for i in range(len(TEXTS))}
    assert all(np.linalg.norm(r.embedding) == pytest.approx(1, abs=1e-5) for r in rows)

    def lengths():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    own = {r.task_id: r.embedding for r in FE.embed_texts(docs, "cleaned_text", lengths).collect()}
    assert own["0"][0] / own["0"][1] == pytest.approx(len(TEXTS[0]), rel=1e-4)


def test_hashed_vectors_know_words_and_pairs(spark):
    texts = ["new bank account", "New bank account", "account bank new", "", None, "..."]
    df = spark.createDataFrame(list(enumerate(texts)), "task_id int, t string")
    v = {r.task_id: np.array(r.embedding) for r in FE.embed_texts(df, "t").collect()}
    assert all(len(x) == 256 for x in v.values()) and not v[3].any() and not v[4].any() and not v[5].any()
    assert v[0] @ v[1] == pytest.approx(1, abs=1e-5) and 0.2 < v[0] @ v[2] < 0.95


def test_damping_takes_the_logarithm_of_counts(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(0, Vectors.sparse(4, [1, 3], [1.0, 3.0])), (1, Vectors.sparse(4, [], [])), (2, Vectors.sparse(4, [0], [2.0]))], ["i", "counts_"])
    got = {r.i: r.tf_.toArray().tolist() for r in FE.SublinearTf().transform(df).collect()}
    assert got == {0: [0, 1, 0, pytest.approx(1 + np.log(3))], 1: [0] * 4, 2: [pytest.approx(1 + np.log(2)), 0, 0, 0]}


def test_csv_begins_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("1", ' a "b"\nc', ["x"]), ("2", "é,", [])], "task_id string, name string, tags array<string>").repartition(2, "task_id")
    S.write_table(df, str(tmp_path / "t"), "csv", bom=True)
    files = [p.read_bytes() for p in (tmp_path / "t").glob("part-*") if p.stat().st_size]
    assert files and all(f.startswith(b'\xef\xbb\xbf"task_id","name","tags"\n') for f in files)
    assert {(r.task_id, r.name) for r in S.read_tasks(spark, str(tmp_path / "t"), ["task_id", "name", "tags"]).collect()} == {("1", ' a "b"\nc'), ("2", "é,")}


def test_reduction_keeps_the_main_axis(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)) * np.array([5, 1, 0.1, 0.1, 0.1, 0.1])
    df = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "task_id string, embedding array<double>")
    out = {r.task_id: r.reduced for r in FE.reduce_dims(df, 2).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    axis = np.linalg.eigh(np.cov(u.T))[1][:, -1]
    got, want = np.array([out[str(i)][0] for i in range(200)]), u @ axis
    assert abs(np.corrcoef(got, want)[0, 1]) == pytest.approx(1, abs=1e-6)


def test_rerank_prefers_different_terms(spark):
    terms = spark.createDataFrame([(0, "a", 1.0), (0, "a2", 0.9), (0, "b", 0.5)], "topic_id bigint, term string, score double")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("a2", [1.0, 0.01]), ("b", [0.0, 1.0])], "term string, vector array<double>")
    order = [r.term for r in FE.mmr_rerank(terms, vectors, diversity=0.9).orderBy("rank").collect()]
    assert order.index("b") == 1
    plain = [r.term for r in FE.mmr_rerank(terms, vectors, diversity=0.0).orderBy("rank").collect()]
    assert plain[-1] == "b"


@pytest.fixture(scope="module")
def model(docs):
    return CF.train_tfidf_logreg(CF.tfidf_input(docs), max_iter=50)


@pytest.fixture(scope="module")
def pillars(spark):
    return spark.createDataFrame([("account", "Accounts")], "label string, business_pillar string")


def test_scoring(spark, model, pillars):
    df = spark.createDataFrame([("1", "Please open a NEW account"), ("2", "billing invoice"), ("3", " hi "), ("4", "mail a@b.co about the invoice")],
                               "task_id string, text string")
    rows = {r.task_id: r for r in CF.score(df, model, pillars).collect()}
    assert rows["1"].sub_type == "account" and rows["1"].issue_type == "Accounts" and rows["1"].confidence > 0.5
    assert rows["2"].sub_type == "invoice" and rows["2"].issue_type == "Unknown"
    assert rows["3"].sub_type == "Unknown" and rows["3"].confidence == 0.0 and rows["3"].alternatives == []
    assert rows["1"].alternatives[0].sub_type == "invoice"
    assert rows["1"].confidence + rows["1"].alternatives[0].confidence == pytest.approx(1)
    batch = {r.task_id: r.sub_type for r in CF.score_batch(df, model, pillars).collect()}
    assert batch == {k: v.sub_type for k, v in rows.items()}


def test_model_survives_saving(spark, model, docs):
    loaded = S.model_io(f"{shared_folder(spark)}/m-{uuid.uuid4().hex}", model)
    ready = CF.tfidf_input(docs)
    both = [[r.predicted for r in m.transform(ready).orderBy("task_id").collect()] for m in (model, loaded)]
    assert both[0] == both[1] == [r.label for r in docs.orderBy("task_id").collect()]


def test_coefficients_explain(spark, model, docs):
    coefficients = CF.coefficient_table(model, spark)
    weights = FE.tfidf_features(docs, "cleaned_text").select("task_id", "term", "weight")
    top = CF.explain_prediction(weights, coefficients, docs.select("task_id", "label")).filter("rank = 1 and task_id = '0'").first()
    assert "account" in top.term or "new" in top.term


def test_cross_validation_predicts_every_row_once(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), [float(v) for v in rng.normal([3 * (i % 2), 0], 0.3)], "odd" if i % 2 else "even") for i in range(40)]
    data = CF.as_features(spark.createDataFrame(rows, "task_id string, embedding array<double>, label string"))
    out = CF.cross_val_predict(data, lambda part: CF.train_logreg(part, C=100.0, max_iter=50)).collect()
    assert sorted(int(r.task_id) for r in out) == list(range(40))
    assert sum(r.label == r.predicted for r in out) == 40


def test_regression_matches_its_objective(spark):
    """At the optimum the gradient of  sum of losses * C + |w|^2 / 2  vanishes."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=60) > 0).astype(int)
    data = CF.as_features(spark.createDataFrame([(str(i), [float(v) for v in r], "ab"[c]) for i, (r, c) in enumerate(zip(x, y))],
                                                "task_id string, embedding array<double>, label string"))
    lr = CF.train_logreg(data, C=2.0).stages[0]
    w, b = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gradient = 2.0 * (p - np.eye(2)[y]).T @ x + w
    assert np.abs(gradient).max() < 1e-2


def test_csv_round_trip(spark, tmp_path):
    path = tmp_path / "tasks.csv"
    path.write_text('﻿ Task ID ,Name,Notes\n1,"a, ""b""","line one\nline two"\n2,NA,\n', encoding="utf-8")
    rows = S.read_tasks(spark, str(path), ["Task ID", "Name", "Notes"]).collect()
    assert [tuple(r) for r in rows] == [("1", 'a, "b"', "line one\nline two"), ("2", "NA", "")]


def test_contract(spark):
    good = spark.createDataFrame([("1", "x"), ("2", "y")], "task_id string, cleaned_text string")
    assert S.validate_contract(good) is good
    with pytest.raises(ValueError):
        S.validate_contract(good.union(good))
    with pytest.raises(ValueError):
        S.validate_contract(good.drop("cleaned_text"))


def test_entity_dictionary(spark, tmp_path):
    path = tmp_path / "names.yaml"
    path.write_text("platforms:\n  portfolio: [Rewh, Tamsin]\nbanks: [tamsin, Gold]\n")
    rows = {r.name: r.category for r in S.read_entity_dict(spark, str(path)).collect()}
    assert rows == {"Rewh": "platforms.portfolio", "tamsin": "banks", "Gold": "banks"}
    assert S.read_entity_dict(spark, str(tmp_path / "none.yaml"), {"x": ["A"]}).first().category == "x"


def test_json_map(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"b": "2", "a": "1"}, indent=2))
    table = S.json_map_to_table(spark, str(path))
    assert {r.key: r.value for r in table.collect()} == {"a": "1", "b": "2"}
    assert json.loads(S.table_to_json_map(table, "key", "value").first().json) == {"a": "1", "b": "2"}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Three files, the last with a row far behind the watermark.

    Spark judges lateness by the watermark of the batch before.
    """
    folder = str(tmp_path_factory.mktemp("in"))
    schema = "task_id string, text string, ts timestamp, label string"
    one = [("1", "Mail a@b.co now", "2024-01-01 10:00:00", "x"), ("2", "open account", "2024-01-02 10:00:00", "x"), ("3", "open account", "2024-01-05 10:00:00", "y")]
    two = [("5", "open account", "2024-01-05 11:00:00", "y")]
    three = [("4", "late row", "2024-01-01 11:00:00", "x"), ("6", "end", "2024-01-09 00:00:00", "y")]
    for rows in (one, two, three):
        spark.createDataFrame(rows, "task_id string, text string, ts string, label string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # the file source orders by modification time
    return folder, schema


def drained(spark, stream):
    folder = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    jobs.run_available(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_stream_equals_batch_for_stateless_jobs(spark, parts, model, pillars):
    folder, schema = parts
    batch, stream = spark.read.schema(schema).parquet(folder), jobs.read_stream(spark, folder, schema)
    cleaned = {r.task_id: r.cleaned_text for r in drained(spark, jobs.stream_clean_mask(stream, "text")).collect()}
    assert cleaned == {r.task_id: r.cleaned_text for r in jobs.stream_clean_mask(batch, "text").collect()} and cleaned["1"] == "mail [email] now"
    scored = {r.task_id: r.sub_type for r in drained(spark, jobs.stream_score(stream, model, pillars)).collect()}
    assert scored == {r.task_id: r.sub_type for r in CF.score(batch, model, pillars).collect()}


def test_stream_volume_drops_late_rows(spark, parts):
    folder, schema = parts
    stream = jobs.read_stream(spark, folder, schema, files_per_trigger=1)
    got = {(str(r.window_start)[:10], r.label): r.n for r in drained(spark, jobs.stream_volume(stream, "ts", "label")).collect()}
    assert got == {("2024-01-01", "x"): 1, ("2024-01-02", "x"): 1, ("2024-01-05", "y"): 2}


def test_stream_dedup_keeps_one_within_the_delay(spark, parts):
    folder, schema = parts
    out = drained(spark, jobs.stream_dedup(jobs.read_stream(spark, folder, schema), "text", "ts", "10 days")).collect()
    assert sorted(r.text for r in out) == ["Mail a@b.co now", "end", "late row", "open account"]


@pytest.mark.parametrize("slots", [64, 1 << 26])
def test_counting_filter_loses_no_frequent_term(spark, slots):
    """Single words ``u<i>``, pairs ``p<i>`` and a word of all texts; a filter that is much too small drops less, never wrongly."""
    rows = [(str(i), f"common u{i} p{i // 2} p{i // 2}") for i in range(400)] + [("e", ""), ("n", None), ("0", "common twice")]
    df = spark.createDataFrame(rows, "task_id string, text string")
    plain = {(r.task_id, r.term): r.tf for r in FE.long_terms(df, "text", ["task_id"], (1, 2), r"\w+").collect()}
    got = {(r.task_id, r.term): r.tf for r in FE.frequent_terms(df, "text", ["task_id"], 2, (1, 2), r"\w+", slots=slots).collect()}
    holders = {}
    for key, term in plain:
        holders.setdefault(term, set()).add(key)
    assert got.items() <= plain.items()
    assert all(pair in got for pair in plain if len(holders[pair[1]]) > 1)
    rare = sum(len(holders[p[1]]) == 1 for p in plain)
    assert (len(got) - (len(plain) - rare) < rare / 3) == (slots > 64)
    counted = FE.count_vectors(df, "text", ngrams=(1, 2), pattern=r"\w+").collect()
    assert {(r.task_id, r.term): r.tf for r in counted} == {p: n for p, n in plain.items() if len(holders[p[1]]) > 1}
    assert FE.count_vectors(df.limit(0), "text").count() == 0


def test_terms_are_counted_without_moving_them(spark, capfd, monkeypatch):
    """Texts are dealt by id once and their terms counted in place; terms sent to all tasks and others give the same table."""
    texts = [f"common w{i % 7} w{i % 50} only{i} common" for i in range(200)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("0", texts[0])], "task_id string, text string")
    plans, plain = [], FE.checkpointed
    monkeypatch.setattr(FE, "checkpointed", lambda d: plans.append(d) or plain(d))
    full = {(r.task_id, r.term): r.weight for r in FE.tfidf_features(df, "text").collect()}
    plans[-1].explain()
    shown = capfd.readouterr().out.split("Initial Plan")[0]
    assert shown.count("Exchange hashpartitioning(task_id") == 1 and "Exchange hashpartitioning(task_id#" in shown and "term#" not in "".join(
        line for line in shown.splitlines() if "Exchange hashpartitioning" in line)
    monkeypatch.setattr(FE, "BROADCAST_ROWS", 3)
    few = {(r.task_id, r.term): r.weight for r in FE.tfidf_features(df, "text").collect()}
    assert full.keys() == few.keys() and all(abs(full[k] - few[k]) < 1e-12 for k in full)
    counted = {(r.task_id, r.term): r.tf for r in FE.count_vectors(df, "text", ngrams=(1, 1)).collect()}
    assert counted["0", "common"] == 4 and counted["1", "common"] == 2


def test_training_steps_have_no_more_tasks_than_cores(spark, docs):
    """Every task of a step sends sums as long as the model, so their number must not grow with the rows."""
    cores = spark.sparkContext.defaultParallelism
    assert CF.one_a_core(spark.range(0, 100, 1, 5 * cores)).rdd.getNumPartitions() <= cores
    ready = CF.tfidf_input(docs).withColumnRenamed("cleaned_text", "t")
    model, rows = FE.fit_transform_tfidf(ready, "t", ["label"])
    again = sorted((r.label, tuple(r.features.toArray().round(9))) for r in model.transform(ready).select("label", "features").collect())
    assert sorted((r.label, tuple(r.features.toArray().round(9))) for r in rows.select("label", "features").collect()) == again
