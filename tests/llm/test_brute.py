"""Language identification and pseudo-likelihood against plain computations of the same quantities."""

import math

import numpy as np
from pyspark.sql import functions as F

from tasksieve.llm.language import LANDMARKS_PER_LANGUAGE, RIDGE, ROWS_PER_LANGUAGE
from tasksieve.llm.likelihood import HIDDEN, TOKENS, WIDTH, WindowNetwork, byte_table, corpus_windows, train_network, windows
from tasksieve.llm.queries import QUERIES
from tests.llm.conftest import FOLDER


def spectrum(text):
    """The set of 1-, 2- and 3-grams of a text, runs of non-letters as one sign."""
    signs = []
    for char in text or "":
        low = char.lower()[0]
        sign = "_" if not char.isalpha() else low if "a" <= low <= "z" else ord(low) % 37
        if sign != "_" or signs[-1:] != ["_"]:
            signs.append(sign)
    return {tuple(signs[i:i + n]) for n in (1, 2, 3) for i in range(len(signs) - n + 1)}


def kernel(a, b):
    return np.array([[len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for y in b] for x in a])


def test_language_query_equals_explicit_kernel_ridge(spark):
    """Regression on the landmarks' kernel columns, penalised by their kernel matrix: no eigenvectors, no folded weights."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("hash"),
                       (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("out")).collect()
    seen = {}
    for r in sorted((r for r in rows if not r.out and r.lang is not None and r.text is not None), key=lambda r: (r.hash, r.doc_id)):
        seen.setdefault(r.lang, []).append(r)
    languages = sorted(seen)
    learned = [r for g in languages for r in seen[g][:ROWS_PER_LANGUAGE]]
    marks = [spectrum(r.text) for g in languages for r in seen[g][:LANDMARKS_PER_LANGUAGE]]
    a = np.c_[kernel([spectrum(r.text) for r in learned], marks), np.ones(len(learned))]
    penalty = np.zeros((len(marks) + 1,) * 2)
    penalty[:-1, :-1] = RIDGE * len(learned) * kernel(marks, marks)
    y = np.array([[1.0 if r.lang == g else -1.0 for g in languages] for r in learned])
    solved = np.linalg.lstsq(a.T @ a + penalty, a.T @ y, rcond=1e-12)[0]
    want = np.c_[kernel([spectrum(r.text) for r in rows], marks), np.ones(len(rows))] @ solved
    got = {r["doc_id"]: r for r in QUERIES["op6_language_id"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r, values in zip(rows, want):
        assert abs(got[r.doc_id]["score"] - min(1.0, max(0.0, (values.max() + 1) / 2))) < 2e-3
        if np.sort(values)[-1] - np.sort(values)[-2] > 0.01:
            assert got[r.doc_id]["lang_pred"] == languages[int(values.argmax())]


def plain_log_prob(weights, before, byte, after):
    """log P(byte | two bytes on each side); None is beyond the text."""
    embed, w1, b1, w2, b2 = (w.astype(np.float64) for w in weights)
    x = np.concatenate([embed[k][0 if c is None else c + 1] for k, c in enumerate((*before, *after))])
    z = np.tanh(x @ w1 + b1) @ w2 + b2
    top = z.max()
    return z[byte + 1] - top - math.log(sum(math.exp(v - top) for v in z))


def test_pseudo_likelihood_query_equals_a_plain_sum_over_bytes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    network = train_network(corpus_windows(docs.select(F.col("text").cast("binary").alias("raw"))))
    got = {r["doc_id"]: r for r in QUERIES["op7_pseudo_likelihood"](spark, FOLDER).collect()}
    assert [w.shape for w in network.weights] == [(4, TOKENS, WIDTH), (4 * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, TOKENS), (TOKENS,)]
    known = {}
    for r in docs.orderBy("doc_id").collect()[::7]:
        padded = [None, None, *(r["text"] or "").encode(), None, None]
        total = 0.0
        for i in range(2, len(padded) - 2):
            window = tuple(padded[i - 2:i + 3])
            if window not in known:
                known[window] = plain_log_prob(network.weights, window[:2], window[2], window[3:])
            total += known[window]
        n = len(padded) - 4
        assert got[r["doc_id"]]["n_tokens"] == n
        assert abs(got[r["doc_id"]]["log_prob"] - total) <= 1e-3 * max(1, n)


def test_first_step_follows_the_numeric_gradient():
    """The first Adam step moves every weight by the rate, against the sign of its derivative."""
    rng = np.random.default_rng(4)
    code = np.unique(windows([bytes(rng.integers(97, 103, 60, dtype=np.uint8))], byte_table())[0])
    count = rng.integers(2, 5, len(code))
    start = WindowNetwork([w.astype(np.float64) for w in WindowNetwork.fresh(3, TOKENS).weights])
    trained = WindowNetwork([w.copy() for w in start.weights])
    trained.train(code, count, 1, len(code), 0, 0.01)

    def loss(weights):
        return -(count / count.mean() * WindowNetwork(weights).log_probs(code)).mean()

    checked = 0
    for which, w in enumerate(start.weights):
        for at in rng.permutation(w.size)[:400]:
            near = [[x.copy() for x in start.weights] for _ in range(2)]
            near[0][which].flat[at] += 1e-5
            near[1][which].flat[at] -= 1e-5
            slope = (loss(near[0]) - loss(near[1])) / 2e-5
            if abs(slope) > 1e-5:
                moved = trained.weights[which].flat[at] - w.flat[at]
                assert abs(moved + 0.01 * np.sign(slope)) < 1e-4
                checked += 1
    assert checked > 200
