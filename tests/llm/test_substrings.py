"""Chunk and suffix-array dedup against brute force."""

import hashlib
import random

import pytest

from tasksieve.llm.chunks import chunk_dedup, chunk_digests, chunk_ends
from tasksieve.llm.queries import QUERIES
from tasksieve.llm.suffixes import sampled, substring_dedup
from tests.llm.conftest import FOLDER, ODD


def plain(rows, length=100):
    """rows: (id, text) with distinct ids -> {id: (bytes, removed, spans, sha of the rest)}; null ids last."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            window = raw[s:s + length]
            if window in seen:
                gone[s:s + length] = b"\x01" * length
            seen.add(window)
        left = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def result(df, id="key"):
    return {r[id]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_suffix_query_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert result(QUERIES["op9_suffix_dedup"](spark, FOLDER), "doc_id") == plain(rows)


@pytest.mark.parametrize("batches, together", [(1, 20_000), (3, 1), (7, 20_000)])
def test_suffixes_of_small_strings(documents, batches, together):
    rng = random.Random(batches)
    passages = ["".join(rng.choice("abcd") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcd") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))) for _ in range(80)]
    texts += ["a" * 300, "ab" * 150, "a" * 40, "é" * 50, texts[3], texts[3]]
    rows = list(enumerate(texts))
    docs = documents([(i, t, "en", "s") for i, t in rows])
    assert result(substring_dedup(docs, length=20, gram=6, batches=batches, together=together)) == plain(rows, 20)


def test_sampled_runs_hold_every_string_once():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 19, 20, 21, 500, 3000)]
    for piece in (1 << 22, 64):
        got = sorted((int(k), w) for part in sampled(texts, 20, 6, piece) for k, s, p, a, _ in zip(*part) for w in range(s, p) if w <= a <= w + 14)
        assert got == [(k, s) for k, t in enumerate(texts) for s in range(len(t) - 19)]


def test_suffix_odd_rows(documents):
    docs = documents([(*r, 1, "x") for r in ODD], ", n_bytes int, spans string")
    got = substring_dedup(docs).collect()
    assert len(got) == len(ODD)
    unique = {(i, t) for i, t, *_ in ODD if not (i is None and t is None) and i not in (5,)}
    want = plain(unique)
    for r in got:
        if r["key"] in (7, 8, 10):
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["key"]]
        else:
            assert r["n_removed"] == 0
    assert substring_dedup(docs.limit(0)).count() == 0
    twice = documents([(1, "some words " * 3 + "z" * 10 + str(list(range(60))), "en", "a")] * 2)
    assert {r["n_removed"] for r in substring_dedup(twice).collect()} == {0}


def plain_chunks(rows, run=64):
    owner, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        ends, digests = chunk_digests(raw)
        mine, runs = set(), []
        for a, b, d in zip([0, *ends], ends, digests):
            if d in mine or owner.get(d, i) != i:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            mine.add(d)
        for d in mine:
            owner.setdefault(d, i)
        runs = [r for r in runs if r[1] - r[0] >= run]
        left = b"".join(raw[a:b] for a, b in zip([0, *[r[1] for r in runs]], [*[r[0] for r in runs], len(raw)]))
        out[i] = (len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest())
    return out


def test_chunk_query_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert result(QUERIES["op4_chunk_dedup"](spark, FOLDER), "doc_id") == plain_chunks(rows)


def test_chunks_resist_shifts():
    rng = random.Random(4)
    passage = bytes(rng.randrange(97, 123) for _ in range(3000))
    _, base = chunk_digests(passage)
    _, moved = chunk_digests(b"something new in front " + passage[:1000] + b"!" + passage[1000:])
    assert len(set(base) - set(moved)) <= 6
    assert chunk_ends(b"") == [] and chunk_ends(b"a" * 1200)[-1] == 1200
    assert all(b - a <= 512 for a, b in zip([0, *chunk_ends(passage)], chunk_ends(passage)))


def test_chunk_passages_are_caught(documents):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passage, rows = text(55), []
    for i in range(40):
        rows.append((i, text(80) + (" " + passage + " " if i % 2 else " ") + text(60), "en", "s"))
    got = {r["key"]: r["n_removed"] for r in chunk_dedup(documents(rows)).collect()}
    assert all((got[i] > 0) == (i % 2 == 1 and i > 1) for i in got)


def test_chunk_passages_of_two_copies(documents):
    """A passage of 250 bytes in two documents with other surroundings is caught for every seed, and most of its bytes go."""
    size, seeds, rows = 250, 80, []
    for seed in range(seeds):
        rng = random.Random(1000 + seed)
        text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
        passage = text(90)[:size]
        rows += [(2 * seed, f"{text(40)} {passage} {text(30)}", "en", "s"), (2 * seed + 1, f"{text(50)} {passage} {text(20)}", "en", "s")]
    got = {r["key"]: r["n_removed"] for r in chunk_dedup(documents(rows)).collect()}
    shares = [got[2 * seed + 1] / size for seed in range(seeds)]
    assert not any(got[2 * seed] for seed in range(seeds))
    assert min(shares) > 0 and sum(shares) / seeds > 0.65


def test_chunk_odd_rows(documents):
    docs = documents([(*r, 1, "x") for r in ODD], ", number int, tag string")
    got = chunk_dedup(docs, texts=True).collect()
    assert len(got) == len(ODD) and all(r["n_bytes"] - r["n_removed"] == len(r["kept"]) for r in got)
    assert chunk_dedup(docs.limit(0)).count() == 0
