"""Spelling variants against a plain comparison of all words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tasksieve.llm import spelling
from tasksieve.llm.queries import QUERIES
from tasksieve.llm.spelling import near_pairs, spelling_variants
from tests.llm.conftest import FOLDER, ODD


def counted(rows, least=3):
    """rows: (id, text) -> {word: n}."""
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= least}


def one_apart(a, b):
    """Exactly one edit, by the common beginning and end."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def plain(rows):
    n = counted(rows)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = collected(QUERIES["op12_spelling_variants"](spark, FOLDER))
    assert got == plain(rows) and sum(r[1] is not None for r in got) > 100


def random_rows(seed, alphabet, length, size):
    rng = np.random.default_rng(seed)
    letters = list(alphabet)
    words = ["".join(rng.choice(letters, rng.integers(4, length))) for _ in range(size)]
    return [(k, " ".join(rng.choice(words, 60) if k % 3 else rng.choice(words[:9], 60)) + " 1x") for k in range(60)]


@pytest.mark.parametrize("seed,alphabet,length", [(0, "ab", 9), (1, "abé", 7), (2, "aA×z", 7)])
def test_repeated_letters(spark, seed, alphabet, length):
    rows = random_rows(seed, alphabet, length, 60)
    got = collected(spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == plain(rows) and any(r[4] > 2 for r in got)


@pytest.mark.parametrize("limit", [0, 6, 64])
def test_long_words_by_hash(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "TEXT_ROTATION", limit)
    base = "abcde" * 20
    long = [base, base[:-1], base + "x", "z" + base, base[:50] + "q" + base[50:], base[:50] + "Q" + base[51:], "y" * 3000, "y" * 3001, "y" * 2999 + "z"]
    text = " ".join(w for k, w in enumerate(long) for _ in range(3 + 2 * k)) + " aabbb aabb aabb aabb aabbb aabbb aabbbb aabbbb aabbbb abbbb abbbb abbbb"
    rows = [(k, text) for k in range(4)] + [(9, "aabbb " * 500)]
    assert collected(spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"))) == plain(rows)


def test_pairs(spark):
    rows = random_rows(5, "abc", 8, 80)
    n = counted(rows)
    words = spark.createDataFrame(list(n.items()), "word string, n bigint")
    got = sorted(tuple(r) for r in near_pairs(words).collect())
    assert got == sorted((a, b, n[b]) for a in n for b in n if one_apart(a, b))


def test_odd_rows(spark, documents, monkeypatch):
    rows = ODD + [(None, "Wörter wörter Wörter", None, None), (11, "chain " * 40 + "chein " * 10 + "cheins " * 4, "en", "a")] * 2
    df = documents([(*r, k, k) for k, r in enumerate(rows)], extra=", word bigint, n bigint")
    want = plain([r[:2] for r in rows])
    assert collected(spelling_variants(df)) == want
    monkeypatch.setattr(spelling, "PIECE", 7)  # texts in many pieces
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    assert collected(spelling_variants(df)) == want
    assert collected(spelling_variants(df.limit(0))) == []
