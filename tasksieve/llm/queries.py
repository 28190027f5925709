"""The registered queries of the operators, with production parameters, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasksieve.llm.common import read
from tasksieve.llm.chunks import chunk_dedup
from tasksieve.llm.exact import exact_dedup
from tasksieve.llm.language import identify
from tasksieve.llm.likelihood import pseudo_likelihood
from tasksieve.llm.mixing import Mix
from tasksieve.llm.pieces import encode_documents
from tasksieve.llm.quality import quality_scores
from tasksieve.llm.simhash import simhash_groups
from tasksieve.llm.spelling import spelling_variants
from tasksieve.llm.suffixes import substring_dedup
from tasksieve.llm.urls import judge_pages
from tasksieve.llm.vectors import embedding_groups
from tasksieve.llm.whitening import whiten
from tasksieve.sources.tables import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read(spark, sf_dir, "documents", "doc_id"))
    return groups.select(F.col("key").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                         F.col("component").alias("component_id"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources; documents have no path, so the language stands for it."""
    return quality_scores(read(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels")).withColumnRenamed("key", "doc_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents", "doc_id")).select(
        F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(read(spark, sf_dir, "documents", "doc_id")).withColumnRenamed("key", "doc_id")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = embedding_groups(read(spark, sf_dir, "embeddings", "vec_id"))
    return groups.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents", "doc_id")).withColumnRenamed("key", "doc_id")


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(read(spark, sf_dir, "documents", "doc_id")).withColumnRenamed("key", "doc_id")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(read(spark, sf_dir, "documents", "doc_id")).taken().withColumnRenamed("key", "doc_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents", "doc_id")).withColumnRenamed("key", "doc_id").drop("spans")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents", "doc_id")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("key", "doc_id")


#: Fixed by the query's contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(read(spark, sf_dir, "pages", "page_id"), URL_RULES).withColumnRenamed("key", "page_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents", "doc_id"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings", "vec_id")).withColumnRenamed("key", "vec_id")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_exact_dedup, op4_chunk_dedup, op5_embedding_dedup, op6_language_id, op7_pseudo_likelihood, op8_mix_sources, op9_suffix_dedup, op10_sentencepiece, op11_redirect_rules, op12_spelling_variants, op13_embedding_whitening)}

ORACLE = {
    "op3_exact_dedup": """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_redirect_rules": r"""WITH RECURSIVE cut AS (SELECT page_id, url, html, position('://' IN url) AS pos FROM pages),
rest AS (SELECT page_id, html, CASE WHEN pos > 0 THEN url[pos + 3:] ELSE '' END AS rest,
    CASE WHEN pos > 0 THEN translate(url[:pos - 1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS scheme FROM cut),
split AS (SELECT page_id, html, scheme, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
own AS (SELECT page_id, html, scheme, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest[length(raw) + 1:], '^[^?#]*') AS path, regexp_extract(rest[length(raw) + 1:], '^[^#]*') AS tail FROM split),
shown AS (SELECT scheme, host, path, scheme || '://' || host || tail AS node,
    regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS html FROM own WHERE scheme IS NOT NULL AND html IS NOT NULL),
tags AS (SELECT scheme, host, path, node, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag, 'href' AS kind FROM shown
    UNION ALL SELECT scheme, host, path, node, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')), 'content' FROM shown),
told AS (SELECT scheme, host, path, node, kind, trim(replace(regexp_replace(CASE kind
      WHEN 'href' THEN regexp_extract(tag, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)
      ELSE regexp_extract(tag, '(?is)\scontent\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) END, '^["'']|["'']$', '', 'g'), '&amp;', '&')) AS value FROM tags
    WHERE CASE kind WHEN 'href' THEN regexp_matches(tag, '(?is)\srel\s*=\s*(?:canonical[\s/>]|"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?'')')
      ELSE regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh\b') END),
target AS (SELECT scheme, host, path, node, CASE kind WHEN 'href' THEN value
    ELSE trim(regexp_replace(regexp_extract(value, '(?is);\s*url\s*=\s*(.*)$', 1), '^["'']|["'']$', '', 'g')) END AS t FROM told),
whole AS (SELECT node, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN t = '' OR starts_with(t, '#') THEN NULL
    WHEN starts_with(t, '//') THEN scheme || ':' || t WHEN starts_with(t, '/') THEN scheme || '://' || host || t
    WHEN starts_with(t, '?') THEN scheme || '://' || host || path || t WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^.*/') END || t END AS t FROM target),
ends AS (SELECT node AS a, t, position('://' IN t) AS pos, regexp_extract(t[position('://' IN t) + 3:], '^[^/?#]*') AS raw FROM whole WHERE t IS NOT NULL),
links AS (SELECT DISTINCT a, translate(t[:pos + 2] || raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t[pos + 3 + length(raw):], '^[^#]*') AS b FROM ends),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged AS (SELECT node, rule.verdict FROM (SELECT DISTINCT other AS node, regexp_extract(other, '://([^/?#]*)', 1) AS h, regexp_extract(other, '://[^/?#]*([^?#]*)', 1) AS p FROM reach), rules rule
    WHERE (h = rule.host OR ends_with(h, '.' || rule.host)) AND starts_with(p, rule.path)
    QUALIFY row_number() OVER (PARTITION BY node ORDER BY length(rule.host) + length(rule.path) DESC, length(rule.host) DESC) = 1),
class AS (SELECT r.node, min(j.verdict) AS verdict FROM reach r JOIN judged j ON j.node = r.other GROUP BY r.node),
numbered AS (SELECT row_number() OVER () AS k, page_id, host, path, scheme || '://' || host || tail AS node FROM own),
best AS (SELECT k, rule.host || rule.path AS rule, rule.verdict FROM numbered o, rules rule
    WHERE (o.host = rule.host OR ends_with(o.host, '.' || rule.host)) AND starts_with(o.path, rule.path)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule.host) + length(rule.path) DESC, length(rule.host) DESC) = 1)
SELECT page_id, host, path, best.rule, coalesce(best.verdict, class.verdict, 'allow') AS verdict
FROM numbered LEFT JOIN best USING (k) LEFT JOIN class ON class.node = numbered.node""",
}
