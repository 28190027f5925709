"""Registry of the checked queries, and the inputs they share.

Every query reads the given tables.  ``oracle`` is the same question as SQL for
DuckDB; queries without one are checked by unit tests against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Synthetic entity dictionary (FIXTURES.md) and other deployment parameters.
ENTITIES = [
    ("that with", "platforms.portfolio"), ("rewh", "platforms.portfolio"), ("orre", "platforms.document"),
    ("thatin", "custodians"), ("ononst", "banks"), ("inoran", "clients"), ("hehely", "systems"),
]
TRACKED = ["Rewh", "Orre"]
STOP = ["the", "and", "that", "with", "this", "from", "have"]
PLACEHOLDER = {"platforms.portfolio": "[PORTFOLIO_PLATFORM]", "platforms.document": "[DOCUMENT_PLATFORM]",
               "custodians": "[CUSTODIAN]", "banks": "[BANK]", "clients": "[CLIENT]", "systems": "[CLIENT]"}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return register


# ------------------------------------------------------------- Spark inputs


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"), "text", "lang", "source")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """The documents for work that is heavy per text."""
    scan = spread(table(spark, folder, "documents"), "doc_id")
    return scan.select(F.col("doc_id").cast("string").alias("task_id"), "text", "lang", "source")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("task_id"), "embedding")


def assignment(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("task_id"), F.col("label").cast("bigint").alias("topic_id"))


def topic_docs(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).join(assignment(spark, folder), "task_id")


def order_key(c: str = "task_id"):
    return F.col(c).cast("bigint")


# --------------------------------------------------------------- SQL inputs

DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS task_id, text, lang, source FROM documents)"
VEC = """vec AS (SELECT CAST(vec_id AS VARCHAR) AS task_id, CAST(label AS BIGINT) AS topic_id,
  CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""
UNIT = VEC + """, unit AS (SELECT task_id, topic_id,
  list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS u FROM vec)"""
CENT = UNIT + """, cent_e AS (SELECT topic_id, i, avg(x[i]) AS m FROM vec, range(1, 65) t(i) GROUP BY ALL),
cent_r AS (SELECT topic_id, list(m ORDER BY i) AS m FROM cent_e GROUP BY topic_id),
cent AS (SELECT topic_id, list_transform(m, lambda v: v / sqrt(list_dot_product(m, m))) AS c FROM cent_r)"""
TASKS = """tasks AS (SELECT CAST(d.doc_id AS VARCHAR) AS task_id, split_part(d.text, chr(10), 1) AS name,
  substring(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS notes,
  CASE WHEN d.doc_id % 11 = 5 THEN CAST(d.doc_id - 5 AS VARCHAR) ELSE '' END AS parent_task,
  CASE d.doc_id % 4 WHEN 0 THEN 'Orre Thatin Holdings' WHEN 1 THEN 'Inoran Family Office' WHEN 2 THEN 'n/a' ELSE '' END AS household,
  CASE d.lang WHEN 'en' THEN 'Ada Quill' WHEN 'fr' THEN 'Benoit Marsh' WHEN 'de' THEN 'cora.lind@example.com' ELSE '' END AS assignee,
  DATE '2024-01-01' + CAST(d.doc_id % 360 AS INTEGER) AS created_on,
  CASE WHEN l.quality IS NULL THEN '' WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS issue_type,
  d.source AS platform, CAST(COALESCE(e.label, -1) AS INTEGER) AS topic_id
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sub(expr: str, pattern: str, replacement: str = "", flags: str = "") -> str:
    inline = f"(?{flags})" if flags else ""
    return f"regexp_replace({expr}, {lit(inline + pattern)}, {lit(replacement)}, 'g')"


def strip(expr: str) -> str:
    return sub(expr, rf"^{K.SPACE}+|{K.SPACE}+\z")


def squeeze(expr: str) -> str:
    return strip(sub(expr, r"[ \t]{2,}", " "))


def words(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(r'[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+')}))"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"
