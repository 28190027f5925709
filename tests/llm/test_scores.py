"""Quality posteriors and pseudo-likelihood scores."""

import numpy as np
import pytest

from tasksieve.llm.likelihood import REACH, TOKENS, WindowNetwork, byte_table, corpus_windows, kind_table, pseudo_likelihood, train_network, windows
from tasksieve.llm.quality import fit_evidence, quality_scores
from tasksieve.llm.queries import QUERIES
from tests.llm.conftest import FOLDER, ODD


def test_quality_of_labelled_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op2_quality"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert np.mean([got[i]["kept"] == bool(q) for i, q in labels.items()]) > 0.97
    assert np.mean([got[i]["kept"] for i, q in labels.items() if q]) > 0.99


def test_quality_holds_out(spark):
    """Fitted without a third of the labels, the others are still told right."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    out = {r["doc_id"]: r["quality"] for r in labels.filter("doc_id % 3 = 0").collect()}
    got = {r["key"]: r["kept"] for r in quality_scores(docs, labels.filter("doc_id % 3 <> 0")).collect()}
    assert np.mean([got[i] == bool(q) for i, q in out.items()]) > 0.95


def test_posteriors_by_hand(spark):
    docs = spark.createDataFrame([(i, "good words here and there, all of them fine." if i % 4 else "B@D ## $$ %% !!", f"h{i % 3}", f"p{i % 2}") for i in range(60)] + [(99, "good words here", "rare", "p0")],
                                 "doc_id bigint, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(bool(i % 4))) for i in range(40)], "doc_id bigint, quality int")
    got = quality_scores(docs, labels).collect()
    p = {r["key"]: r["evidence"] for r in got}
    place = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.collect()}
    group = lambda key: [np.array([p[i] for i in p if key(place[i]) == k]) for k in sorted({key(x) for x in place.values()})]
    mu = np.mean(list(p.values()))

    def strength(parts, centres):
        n = np.array([len(x) for x in parts])
        inside = sum(((x - x.mean()) ** 2).sum() for x in parts) / max(1, n.sum() - len(n))
        between = (sum(len(x) * (x.mean() - c) ** 2 for x, c in zip(parts, centres)) - (len(n) - 1) * inside) / (n.sum() - (n**2).sum() / n.sum())
        return min(max(inside / between, 1.0), n.sum()) if between > 0 and inside > 0 else max(1.0, n.sum())

    hosts = sorted({x[0] for x in place.values()})
    host_parts = group(lambda x: x[0])
    k = strength(host_parts, [mu] * len(hosts))
    rate = {h: (x.sum() + k * mu) / (len(x) + k) for h, x in zip(hosts, host_parts)}
    paths = sorted(set(place.values()))
    path_parts = group(lambda x: x)
    raw = {h: x.mean() for h, x in zip(hosts, host_parts)}
    kp = strength(path_parts, [raw[h] for h, _ in paths])
    for r in got:
        x = path_parts[paths.index(place[r["key"]])]
        host = rate[place[r["key"]][0]]
        assert r["host_rate"] == pytest.approx(host) and r["path_rate"] == pytest.approx((x.sum() + kp * host) / (len(x) + kp))
        other = (x.sum() - r["evidence"] + kp * host) / (len(x) - 1 + kp)
        logit = lambda v: np.log(min(max(v, 1e-6), 1 - 1e-6) / (1 - min(max(v, 1e-6), 1 - 1e-6)))
        odds = logit(r["evidence"]) + logit(other) - np.log(mu / (1 - mu))
        assert r["quality"] == pytest.approx(1 / (1 + np.exp(-odds)))


def test_evidence_tells_classes_apart():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 15))
    model = fit_evidence(x, (x[:, 3] > 0).astype(float))
    assert np.mean((model.logits(x) > 0) == (x[:, 3] > 0)) > 0.95


def test_quality_odd_rows(spark, documents):
    docs = documents([(*r, "x", 1) for r in ODD], ", host string, p int")
    labels = spark.createDataFrame([(5, 1), (4, 0), (None, 1), (7, None)], "doc_id bigint, quality int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["quality"] <= 1 for r in got)
    assert all(r["evidence"] == 0 and not r["kept"] for r in got if r["key"] in (1, 2, 3))
    unlabelled = quality_scores(docs, labels.limit(0)).collect()
    assert {r["evidence"] for r in unlabelled} == {0.0, 0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_windows_by_hand():
    table = kind_table()
    texts = [b"", b"a", b"Ab 9!", "é".encode(), b""]
    code, sizes = windows(texts, table)
    want = []
    for t in texts:
        kinds = [0] * REACH + [int(table[c]) for c in t] + [0] * REACH
        for i in range(len(t)):
            a, b, c, d, e = kinds[i:i + 5]
            want.append(c | a << 5 | b << 10 | d << 15 | e << 20)
    assert code.tolist() == want and sizes.tolist() == [len(t) for t in texts]


def test_network_gradients_and_tables():
    net = WindowNetwork.fresh(1)
    code = np.arange(0, 1 << 25, 65537, dtype=np.int32)
    assert np.allclose(np.exp(net._forward(code)[3]).sum(axis=1), 1, atol=1e-4)
    before = net.log_probs(code).mean()
    net.train(code, np.ones(len(code)), 60, 256, 0, 0.01)
    assert net.log_probs(code).mean() > before
    assert np.allclose(net.looked_up(code), net.log_probs(code), atol=1e-5)


def test_scores_sum_over_all_tokens_and_tell_texts_apart(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op7_pseudo_likelihood"](spark, FOLDER).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and all(got[r["doc_id"]]["n_tokens"] == len(r["text"].encode()) for r in rows)
    assert sum(r["n"] for r in corpus_windows(docs.selectExpr("cast(text as binary) raw")).collect()) == sum(r["n_tokens"] for r in got.values())
    mean = np.mean([r["mean_log_prob"] for r in got.values()])
    assert -2.2 < mean < 0  # a uniform guess has -3.47
    noise = "".join(np.random.default_rng(0).choice(list("abcdefghijklmnopqrstuvwxyz0123456789 #%"), 2000))
    extended = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, noise)], "doc_id bigint, text string"))
    scored = {r["key"]: r for r in pseudo_likelihood(extended, steps=150).collect()}
    assert scored[-1]["mean_log_prob"] < min(r["mean_log_prob"] for i, r in scored.items() if i != -1 and r["n_tokens"] > 300)


def test_training_passes_over_every_window():
    class Watched(WindowNetwork):
        def _forward(self, code):
            seen.extend(code.tolist())
            return super()._forward(code)

    rng = np.random.default_rng(3)
    code, count = np.arange(5000, dtype=np.int32) * 6007, rng.integers(1, 50, 5000)
    count[7] = 100_000
    for steps, passes in ((1, 1), (30, 2)):
        seen = []
        net = Watched(WindowNetwork.fresh(1).weights)
        net.train(code, count, steps, 256, 0, 0.01)
        times = dict(zip(*np.unique(seen, return_counts=True)))
        assert set(times) == set(code.tolist()) and all(n % passes == 0 for n in times.values()) and len(seen) <= 1.25 * passes * len(code) + passes


def test_slices_grow_with_the_windows(spark):
    """Four times the windows get four times the mini-batches, and each of them goes into the average."""
    text = np.random.default_rng(5).integers(97, 123, 4096, dtype=np.uint8).tobytes()
    rows = [(c, 1 + c % 3) for c in sorted(set(windows([text], byte_table())[0].tolist()))]
    counts = spark.createDataFrame(rows, "code bigint, n bigint")
    few, many = (train_network(counts, slices=1, rounds=1, steps=1, batch=64, slice_rows=n) for n in (1 << 20, 1 << 10))
    assert not np.allclose(few.weights[1], many.weights[1])
    code, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    alone = WindowNetwork.fresh(0, TOKENS)
    alone.train(code, n, 1, 64, 0, 0.01)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(few.weights, alone.weights))


def test_every_byte_has_a_say(documents):
    """Texts that differ in case, digits, punctuation, accents or the order of non-Latin letters get scores of their own."""
    rng = np.random.default_rng(8)
    words = "мир труд свет город река книга школа".split(), "λόγος κόσμος θάλασσα ημέρα".split(), "مدينة كتاب نهر مدرسة".split(), "中文語言 漢字書籍 河流城市".split()
    rows = [(i, " ".join(rng.choice(words[i % 4], 60)), "xx", "s") for i in range(40)]
    mixed = []
    for i, text, *_ in rows[:4]:
        parts = [list(w) for w in text.split()]
        letters = [c for w in parts for c in w]
        rng.shuffle(letters)  # letters go to other places with as many bytes, blanks stay
        pool = {k: [c for c in letters if len(c.encode()) == k] for k in range(1, 5)}
        mixed.append((100 + i, " ".join("".join(pool[len(c.encode())].pop() for c in w) for w in parts), "xx", "s"))
    variants = ["Paid 100 euros, on 3 May.", "paid 100 euros, on 3 may.", "Paid 927 euros, on 8 May.", "Paid 100 euros# on 3 May%", "école très près", "êcolë trés prês"]
    rows += mixed + [(200 + k, v, "xx", "s") for k, v in enumerate(variants)]
    got = {r["key"]: (r["n_tokens"], r["log_prob"]) for r in pseudo_likelihood(documents(rows)).collect()}
    assert all(got[i][0] == got[100 + i][0] and got[i][1] > got[100 + i][1] + 1 for i in range(4))
    assert len({round(got[200 + k][1], 3) for k in range(len(variants))}) == len(variants)


def test_remembered_windows_make_room():
    net = WindowNetwork.fresh(2, TOKENS)
    net.known = np.full(1 << 22, -1, np.int64), np.zeros(1 << 22, np.float32)
    rng = np.random.default_rng(1)
    for _ in range(3):
        text = rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes()
        code = windows([text, text[:100]], byte_table())[0]
        for _ in range(2):
            assert np.allclose(net.looked_up(code), net.log_probs(code), atol=1e-5)
    a, b = (np.flatnonzero(net.known[0] >= 0)[:2]).tolist()
    code = net.known[0][[a, b]]
    net.known[0][a] = code[1]  # another window sits in the slot of the first
    assert np.allclose(net.looked_up(code), net.log_probs(code), atol=1e-5)


def test_scores_odd_rows(documents):
    docs = documents([(*r, "x", 1) for r in ODD], ", code string, n int")
    got = pseudo_likelihood(docs, steps=20, rounds=1).collect()
    assert len(got) == len(ODD) and all(r["log_prob"] == 0 for r in got if r["n_tokens"] == 0)
    assert pseudo_likelihood(docs.limit(0)).count() == 0
    assert {r["log_prob"] for r in pseudo_likelihood(documents([(1, None, "en", "a"), (2, "", "en", "a")])).collect()} == {0.0}


def test_long_texts_are_cut_without_a_trace():
    """Pieces of a text see their neighbours: all windows are there once, whatever the size of the pieces."""
    import pyarrow as pa

    from tasksieve.llm.likelihood import byte_table, pieces, windows

    texts = [b"", b"a", b"ab", bytes(range(200)) * 3, b"", b"xyz" * 50]
    whole = [windows([t], byte_table())[0].tolist() for t in texts]
    for size in (1, 2, 3, 7, 64, 1 << 20):
        got = [[] for _ in texts]
        for group in pieces(pa.array(texts, pa.binary()), size):
            code, sizes = windows([x for _, x, _ in group], byte_table(), [x for _, _, x in group])
            assert sum(map(lambda g: len(g[1]), group)) <= max(size, 1) + max(map(len, texts)) + 4 and len(code) == sizes.sum()
            at = 0
            for (number, _, _), n in zip(group, sizes):
                got[number] += code[at:at + n].tolist()
                at += n
        assert got == whole
