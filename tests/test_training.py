"""Packed texts, the terms of a vocabulary and Newton steps, against plain Python and numpy."""

import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.operators import classify as C
from tasksieve.operators import features as FE
from tasksieve.operators import logistic


def _grams(text):
    w = re.findall(r"\b[a-z][a-z0-9\-]{1,}\b", (text or "").lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = {"x": ["red", "blue", "sky", "sea"], "y": ["one", "two", "sky", "ten"], "z": ["cat", "dog", "two", "red"]}
    made = [(str(i), " ".join(rng.choice([*words[c], f"own{i}"], int(rng.integers(1, 12)))), c) for i, c in enumerate("xyz" * 30)]
    return made + [("e", "", "x"), ("n", None, "y"), ("m", "red sky", None)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "task_id string, text string, label string").repartition(3, "task_id")


@pytest.mark.parametrize("vocab,bits,tokens", [(10, 22, 1 << 20), (10, 6, 40), (1000, 22, 7)])
def test_most_frequent_terms_are_exact(frame, rows, vocab, bits, tokens, monkeypatch):
    """Few slots, which most terms share, and packs of a few texts give the same terms and numbers."""
    monkeypatch.setattr(FE, "PACK_TOKENS", tokens)
    packs = FE.checkpointed(FE.token_packs(frame, "text", ["task_id"], K.TFIDF_TOKEN))
    assert packs.agg(F.sum("n")).first()[0] == len(rows) and (packs.count() > 10) == (tokens < 100)
    n, df = collections.Counter(), collections.Counter()
    for _, text, _ in rows:
        n.update(_grams(text))
        df.update(set(_grams(text)))
    want = sorted(((t, n[t], df[t]) for t in n if df[t] >= 2), key=lambda r: (-r[1], r[0]))[:vocab]
    assert [tuple(r) for r in FE.most_frequent(packs, vocab, 2, bits)] == want


def test_packed_training_ends_at_the_minimum(frame, rows, monkeypatch):
    """At the end the gradient of the plain loss vanishes, in passes that first-order steps would not do with."""
    monkeypatch.setattr(FE, "PACK_TERMS", 30)
    passes, plain = [], logistic._Loss._pass
    monkeypatch.setattr(logistic._Loss, "_pass", lambda self, *a: passes.append(1) or plain(self, *a))
    model = C.train_tfidf_logreg(C.tfidf_input(frame.withColumnRenamed("text", "cleaned_text")), C=5.0)
    names = model.stages[0].vocabulary
    known = [r for r in rows if r[2] is not None]
    df = collections.Counter(g for r in known for g in set(_grams(r[1])) if g in set(names))
    x = np.zeros((len(known), len(names)))
    for i, r in enumerate(known):
        for g, tf in collections.Counter(_grams(r[1])).items():
            if g in names:
                x[i, names.index(g)] = (1 + np.log(tf)) * (np.log((len(known) + 1) / (df[g] + 1)) + 1)
        x[i] /= np.linalg.norm(x[i]) or 1
    sizes = collections.Counter(r[2] for r in rows)  # rows without a label count for the weights
    a = np.array([len(rows) / len(sizes) / sizes[r[2]] for r in known])
    y = np.array(["xyz".index(r[2]) for r in known])
    w, b = model.stages[-2].coefficientMatrix.toArray(), model.stages[-2].interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    r = (p - np.eye(3)[y]) * a[:, None] / a.sum()
    assert np.abs(r.T @ x + w / (5.0 * len(rows))).max() < 1e-4 and np.abs(r.sum(0)).max() < 1e-4
    assert abs(b.sum()) < 1e-9 and len(passes) < 60
    scored = {s.task_id: s for s in model.transform(frame.withColumnRenamed("text", "cleaned_text")).select("task_id", "features", "probability", "predicted").collect()}
    for i, s in enumerate(known):
        assert np.allclose(scored[s[0]].features.toArray(), x[i]) and np.allclose(scored[s[0]].probability.toArray(), p[i]) and scored[s[0]].predicted == "xyz"[p[i].argmax()]


def test_split_does_not_move_texts(spark, capfd):
    """The same rows as places give, with nulls and repeated ids; texts are not shuffled."""
    rows = [(str(i), "t", "ab"[i % 3 > 0]) for i in range(101)] + [(None, "t", "a"), ("7", "t", None)]
    once = spark.createDataFrame(rows, "task_id string, text string, label string")
    for df in (once, once.union(once), once.limit(0)):
        placed = C.label_position(df, "label").withColumn("is_test", F.col("position") <= F.ceil(F.round(F.col("size") * 0.2, 9)))
        got = C.stratified_split(df, "label")
        count = lambda d: collections.Counter((r.task_id, r.label, r.is_test) for r in d.collect())
        assert got.columns == ["task_id", "text", "label", "is_test"] and count(got) == count(placed)
    capfd.readouterr()
    C.stratified_split(once, "label").explain()
    shown = capfd.readouterr().out
    assert all("text" not in line for line in shown.splitlines() if "Exchange" in line) and "Window" not in shown.split("BroadcastHashJoin")[0]
