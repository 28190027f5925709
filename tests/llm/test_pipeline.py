"""The pipeline's stages against plain versions of what they promise."""

import pytest

import corpus_pipeline
from tests.llm.conftest import FOLDER, ODD
from tests.llm.test_dedup import plain_fingerprint, plain_groups
from tests.llm.test_text_models import MODEL, plain_targets, words

spm = pytest.importorskip("sentencepiece")


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    kept = corpus_pipeline.language_id(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if any(c.isalpha() for c in r["text"] or "")}
    exact = corpus_pipeline.exact_dedup(spark, docs, FOLDER)
    last = {r["text"]: r["doc_id"] for r in rows}
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(last.values())
    near = corpus_pipeline.simhash_dedup(spark, docs, FOLDER)
    heads = set(plain_groups([plain_fingerprint(r["text"]) for r in rows]))
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(rows[g]["doc_id"] for g in heads)
    mixed = corpus_pipeline.mix_sources(spark, docs, FOLDER).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    for source, target in plain_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 0.02 * target + 200


def test_run(spark):
    library = spm.SentencePieceProcessor(model_file=MODEL)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert got and all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 2 for r in got)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    whole = [r for r in got if library.encode(texts[r["doc_id"]]) + [2] == r["ids"]]
    assert len(whole) > len({r["doc_id"] for r in got}) / 2


def test_stages_get_through_odd_rows(spark, documents):
    for docs in (documents([(*r, 1) for r in ODD], ", digest int"), documents([])):
        first = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == first
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
