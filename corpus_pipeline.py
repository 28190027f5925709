"""Documents to training tokens: language, exact copies, near copies, source mix, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the
shared folder and hands it, read again, to the next stage.  All but the last return the columns of
documents; other columns that docs may have are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tasksieve.llm.common import read, text_batches
from tasksieve.llm.exact import drop_exact
from tasksieve.llm.language import keep_identified
from tasksieve.llm.mixing import mixed_documents
from tasksieve.llm.pieces import encode_documents
from tasksieve.llm.simhash import drop_near
from tasksieve.session import checkpointed


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    text_batches(spark)
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    text_batches(spark)
    return drop_exact(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (3-word shingles, at most 2 bits), the document with the smallest id."""
    text_batches(spark)
    return drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents cut to what each pass of the mix takes of them."""
    text_batches(spark)
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and what they decode to as a digest."""
    import public_tokenizers

    text_batches(spark)
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=True).withColumnRenamed("key", "doc_id")


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup),
          ("mix_sources", mix_sources), ("sentencepiece", sentencepiece)]

#: Training, hashing and tokenising cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
