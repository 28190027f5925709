"""Exact duplicates and SimHash against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tasksieve.llm.common import components
from tasksieve.llm.exact import drop_exact, exact_dedup
from tasksieve.llm.queries import ORACLE, QUERIES
from tasksieve.llm.simhash import drop_near, fingerprint, fingerprint_links, ring_slots, simhash_groups
from tests.llm.conftest import FOLDER, ODD
from tests.oracle import connect, difference


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_matches_sql(spark):
    assert difference(spark, connect(FOLDER), QUERIES["op3_exact_dedup"], ORACLE["op3_exact_dedup"], FOLDER) is None


def test_exact_brute_force_with_small_blocks(documents):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 9, 30]))) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    want = {i: (max(j for j, u in enumerate(texts) if u == t), texts.count(t), sha(t)) for i, t in enumerate(texts)}
    got = {r["key"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact_dedup(documents(rows), block=2).collect()}
    assert got == want


def test_exact_survives_digests_that_clash(documents):
    rows = [(i, t, "en", "s") for i, t in enumerate(["aaaa", "bbbb", "aaaa", "cccc", "", None, "ccccd"])]
    weak = lambda block: F.substring(block, 1, 0)
    got = {r["key"]: r["keep_id"] for r in exact_dedup(documents(rows), block=2, digest=weak).collect()}
    assert got == {0: 2, 1: 1, 2: 2, 3: 3, 4: 5, 5: 5, 6: 6}


def test_exact_odd_rows(documents):
    docs = documents([(*r, "k", 1) for r in ODD], ", kept string, row int")
    got = exact_dedup(docs).collect()
    assert len(got) == len(ODD)
    by_text = {}
    for i, t, *_ in ODD:
        by_text.setdefault(sha(t), []).append(i)
    for r in got:
        ids = by_text[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max(i for i in ids if i is not None)
    assert sum(r["kept"] for r in got) == len(by_text)
    kept = drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(sha(r["text"]) for r in kept.collect()) == sorted(by_text)
    assert exact_dedup(docs.limit(0)).count() == 0 and drop_exact(docs.limit(0)).count() == 0


def plain_fingerprint(text, k=3):
    import re
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    """Smallest index reachable by links of at most two bits."""
    head = list(range(len(fps)))
    def find(i):
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 2:
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_query_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    groups = plain_groups(fps)
    want = {r["doc_id"]: (f"{f:016x}", rows[g]["doc_id"]) for r, f, g in zip(rows, fps, groups)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op1_simhash"](spark, FOLDER).collect()}
    assert got == want


@pytest.mark.parametrize("text", ["", "A b", "a  B\tc d", "É É é É", "x y z", "w " * 5000, "a\x1cb c d"])
def test_fingerprint_matches_plain(text):
    assert fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("paired", [0, 3, 10**6])
@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_links_have_the_components_of_brute_force(spark, bits, paired):
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0, 2**64 - 1]
    fps = set(centres)
    while len(fps) < 260:
        x = rng.choice(list(fps)[:60])
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(int(np.uint64(x).astype(np.int64)) for x in fps)
    want = {}
    for a in fps:
        want[a] = {b for b in fps if b != a and bin((a ^ b) & (2**64 - 1)).count("1") <= bits}
    links = fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), bits, paired)
    pairs = {(r["a"], r["b"]) for r in links.collect()}
    assert all(b in want[a] for a, b in pairs)
    got = {r["node"]: r["component"] for r in components(links, "a", "b").collect()}
    seen, todo = {}, fps
    for a in todo:
        if a in seen:
            continue
        stack, part = [a], {a}
        while stack:
            for b in want[stack.pop()] - part:
                part.add(b)
                stack.append(b)
        seen |= dict.fromkeys(part, min(part))
    assert {a: got.get(a, a) for a in fps} == seen


def test_slots_hold_for_every_close_pair():
    rng = random.Random(3)
    for bits in (1, 2, 3, 5):
        slots = ring_slots(bits)
        for _ in range(400):
            d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, bits)))
            assert any(not d & mask and all(bin(d & m).count("1") <= n for m, n in chains) for mask, chains in slots)


def test_simhash_odd_rows(documents):
    docs = documents([(*r, "c", 1) for r in ODD], ", component string, fp int")
    got = simhash_groups(docs).collect()
    assert len(got) == len(ODD)
    blank = [r for r in got if r["fp"] == 0]
    assert {r["key"] for r in blank} == {None, 1, 2, 3} and {r["component"] for r in blank} == {1}
    kept = drop_near(docs).collect()
    assert len(kept) == len({r["fp"] for r in got}) and drop_near(docs).columns == docs.columns
    assert drop_near(docs.limit(0)).count() == 0


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 2000 + i) for i in range(300)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(1, 201), 1), 1000: 1000, **{2000 + i: 1000 for i in range(300)}}
