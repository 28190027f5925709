"""Language identification, mixing and SentencePiece."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tasksieve.llm.language import identify, keep_identified
from tasksieve.llm.mixing import Mix, cut_words, mixed_documents, permuted
from tasksieve.llm.pieces import PieceModel, encode_documents, token_ids
from tasksieve.llm.queries import QUERIES
from tests.llm.conftest import FOLDER, ODD

tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
MODEL = tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------------ language


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op6_language_id"](spark, folder).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert np.mean([rows[r["doc_id"]]["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_language_odd_rows(documents):
    docs = documents([(*r, "x", 0.5) for r in ODD], ", lang_pred string, score double")
    got = {(r["key"], r["lang_pred"]) for r in identify(docs).collect()}
    assert {k for k, g in got if g == "und"} == {None, 1, 2, 3, 9}
    kept = keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 9
    assert identify(docs.limit(0)).count() == 0 and keep_identified(docs.limit(0)).count() == 0
    unlabelled = documents([(1, "some text", None, "a")])
    assert [r["lang_pred"] for r in identify(unlabelled).collect()] == ["und"]


# -------------------------------------------------------------------- mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Water filling round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), [s for s in names if sizes[s]]
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0.0, target[s] - repeats * sizes[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], repeats * sizes[s])
        open_ = [s for s in open_ if target[s] < repeats * sizes[s]]
    return target


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_mix_query_meets_targets(spark, folder):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sizes, taken = {}, {}
    for r in rows.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    want = plain_targets(sizes)
    got = QUERIES["op8_mix_sources"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        source = rows[r["doc_id"]]["source"]
        assert r["size"] == len(words(rows[r["doc_id"]]["text"])) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(want[source]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.02 * target + 200
    again = QUERIES["op8_mix_sources"](spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_permutation_is_one():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        got = permuted(np.arange(n), np.full(n, n), np.full(n, 77))
        assert sorted(got.tolist()) == list(range(n))


def test_mix_odd_rows_and_texts(documents):
    docs = documents([(*r, "x", 5) for r in ODD], ", size string, taken int")
    mix = Mix(docs, block=4)
    got = mix.taken().collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixed_documents(docs, block=4)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    blocks = mix.blocks(docs).collect()
    assert sum(len(words(r["words"])) for r in blocks) >= sum(r["taken"] for r in got) * 0.99
    assert Mix(docs.limit(0)).taken().count() == 0 and mixed_documents(docs.limit(0)).count() == 0


def test_mix_without_words(documents):
    docs = documents([(1, "", "en", "a"), (2, None, "en", "b")])
    assert [(r["size"], r["taken"], r["target"]) for r in Mix(docs).taken().collect()] == [(0, 0, 0.0)] * 2


def test_cut_words():
    assert cut_words(" a  b\tc ", [(0, 1), (1, 3)]) == " a  b\tc " and cut_words("a  b c d", [(0, 2), (3, 4)]) == "a  b\nd"


# -------------------------------------------------------------------- pieces


def test_pieces_match_the_library():
    model, library = PieceModel(MODEL), spm.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    alphabet = "ab ▁ \n\t<>/0123é日\U0001F600àthe in er▁▁  s"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * k for k in range(0, 700, 37)] + [" " * k for k in range(0, 1200, 53)] + ["<s></s><0x0A>", "\x00", "▁", "\n", " \n", "▁" * 5 + "x", "== -- 1111", "x" * 3000]
    texts += ["".join(rng.choice("aeinrst") for _ in range(1500)) for _ in range(3)]
    want = []
    for text in texts:
        ids = library.encode(text) + [2]
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids)
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert model.digests(texts) == want and model.digests(texts, group=50) == want
    noise = [[rng.randrange(32000) for _ in range(8)] for _ in range(500)]
    assert [model.decode(x) for x in noise] == [library.decode(x) for x in noise]


def test_pieces_query(spark):
    library = spm.SentencePieceProcessor(model_file=MODEL)
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {}
    for r in rows:
        ids = library.encode(r["text"] or "") + [2]
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op10_sentencepiece"](spark, FOLDER).collect()}
    assert got == want


def test_pieces_odd_rows(documents):
    docs = documents([(*r, 1) for r in ODD], ", n_tokens int")
    got = encode_documents(docs, MODEL).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["key"] in (1, 2)} == {1}
    assert all(r["decoded"] == (t or "") for r, t in zip(token_ids(documents(ODD[:6]), MODEL).collect(), [x[1] for x in ODD[:6]]))
    assert encode_documents(docs.limit(0), MODEL).count() == 0


def test_columns_of_any_name_stay(spark, documents):
    """The pipeline's first stage hands on every column, whatever it is called."""
    from tasksieve.llm.language import keep_identified

    rows = [(k, "the words of this text", "en", "a", k, k, k) for k in range(5)] + [(9, "12 34", "en", "a", 9, 9, 9)]
    df = documents(rows, extra=", __told bigint, __score bigint, doc bigint")
    got = keep_identified(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["__told"], r["__score"], r["doc"]) for r in got.collect()) == [(k, k, k, k) for k in range(5)]
