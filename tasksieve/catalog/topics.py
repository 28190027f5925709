"""Topic analytics over the given vectors and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.catalog.base import CENT, DOCS, STOP, TASKS, UNIT, VEC, assignment, docs, in_list, lit, order_key, query, texts, topic_docs, vectors, words
from tasksieve.functions import conditions as C
from tasksieve.operators import cluster, features, topics
from tasksieve.sources.tables import tasks

# The given vectors are hardly clustered, so the thresholds are lower than the defaults.
MIN_SIM, MERGE_SIM, MAX_DIST = 0.15, 0.25, 0.8


def rounded(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def _cent(spark, sf):
    return topics.topic_centroid(assignment(spark, sf), vectors(spark, sf))


def _member(spark, sf):
    return cluster.soft_membership(vectors(spark, sf), _cent(spark, sf))


def _best(spark, sf):
    return cluster.best_topic(vectors(spark, sf), _cent(spark, sf))


def _dist(spark, sf):
    return topics.topic_distribution(tasks(spark, sf).select("task_id", F.col("topic_id").cast("bigint").alias("topic_id")))


DIST = f"""{TASKS}, dist AS (SELECT CAST(topic_id AS BIGINT) AS topic_id, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM tasks) AS pct
  FROM tasks WHERE topic_id <> -1 GROUP BY 1)"""
DIST_ALL = f"""{TASKS}, dist AS (SELECT CAST(topic_id AS BIGINT) AS topic_id, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM tasks) AS pct
  FROM tasks GROUP BY 1)"""


def _dist_all(spark, sf):
    return topics.group_share(tasks(spark, sf).select("task_id", F.col("topic_id").cast("bigint").alias("topic_id")), ["topic_id"])


# --------------------------------------------------------------------- terms

_TOPIC_DOCS = f"{DOCS}, {VEC}, td AS (SELECT d.task_id, d.text, d.source, d.lang, v.topic_id FROM docs d JOIN vec v USING (task_id))"
TERMS = f"""{_TOPIC_DOCS}, tt AS (SELECT topic_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}'))) AS term FROM td),
ct AS (SELECT topic_id, term, count(*) AS tf FROM tt WHERE term NOT IN {in_list(STOP)} GROUP BY 1, 2),
sz AS (SELECT topic_id, sum(tf) AS words FROM ct GROUP BY 1), fr AS (SELECT term, sum(tf) AS f FROM ct GROUP BY 1),
sc AS (SELECT topic_id, term, tf / words * ln(1 + (SELECT avg(words) FROM sz) / f) AS score FROM ct JOIN sz USING (topic_id) JOIN fr USING (term)),
terms AS (SELECT topic_id, term, score, row_number() OVER (PARTITION BY topic_id ORDER BY round(score, 9) DESC, term) AS rank FROM sc)"""


def _terms(spark, sf, k=10):
    return features.class_tfidf(topic_docs(spark, sf), "text", k=k, stop=STOP)


@query("class_tfidf", f"WITH {TERMS} SELECT topic_id, rank, term, round(score, 6) AS score FROM terms WHERE rank <= 10")
def _(spark, sf):
    return rounded(_terms(spark, sf), "score")


@query("topic_label", f"WITH {TERMS} SELECT topic_id, string_agg(term, '_' ORDER BY rank) AS topic_label FROM terms WHERE rank <= 4 GROUP BY 1")
def _(spark, sf):
    return features.topic_label(_terms(spark, sf))


@query("topic_keywords", f"WITH {TERMS} SELECT topic_id, string_agg(term, ', ' ORDER BY rank) AS keywords FROM terms WHERE rank <= 10 GROUP BY 1")
def _(spark, sf):
    return features.joined_terms(_terms(spark, sf))


@query("distinctiveness_band", f"""WITH {TERMS} SELECT topic_id, term, CASE WHEN score * 100 >= 0.10 THEN 'Very high' WHEN score * 100 >= 0.05 THEN 'High'
  WHEN score * 100 >= 0.02 THEN 'Moderate' ELSE 'Low' END AS band FROM sc""")
def _(spark, sf):
    return _terms(spark, sf, k=None).select("topic_id", "term", C.distinctiveness_band(F.col("score") * 100).alias("band"))


_TOP_WORDS = f"""{_TOPIC_DOCS}, fw AS (SELECT topic_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}'))) AS term FROM td),
fc AS (SELECT topic_id, term, count(*) AS tf FROM fw WHERE term NOT IN {in_list(STOP)} GROUP BY 1, 2),
top_words AS (SELECT topic_id, term, tf, row_number() OVER (PARTITION BY topic_id ORDER BY tf DESC, term) AS rank FROM fc)"""


def _top_words(spark, sf, label="topic_id"):
    return features.label_top_words(topic_docs(spark, sf), "text", label, stop=STOP)


@query("label_top_words", f"WITH {_TOP_WORDS} SELECT topic_id, rank, term, CAST(tf AS BIGINT) AS tf FROM top_words WHERE rank <= 10")
def _(spark, sf):
    return _top_words(spark, sf)


@query("mmr_rerank")
def _(spark, sf):
    terms = _terms(spark, sf, 30)
    # A term's vector: its share of use in each topic.
    counts = features.class_term_counts(topic_docs(spark, sf), "text", stop=STOP)
    spread = counts.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.map_from_entries(F.collect_list(F.struct("topic_id", "tf"))).alias("m"))
    vecs = spread.select("term", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.coalesce(
        F.try_element_at("m", i.cast("bigint")), F.lit(0)).cast("double")).alias("vector"))
    return rounded(features.mmr_rerank(terms.drop("rank"), vecs), "score")


# ------------------------------------------------------- sizes and confidence


@query("topic_distribution", f"WITH {DIST} SELECT topic_id, CAST(n AS BIGINT) AS n, round(pct, 6) AS pct FROM dist")
def _(spark, sf):
    return rounded(_dist(spark, sf), "pct")


@query("topic_rank", f"WITH {DIST_ALL} SELECT topic_id, CAST(n AS BIGINT) AS n, row_number() OVER (ORDER BY topic_id = -1, n DESC, topic_id) AS rank FROM dist")
def _(spark, sf):
    return topics.topic_rank(_dist_all(spark, sf)).select("topic_id", "n", "rank")


@query("topic_size_band", f"WITH {DIST_ALL} SELECT topic_id, CASE WHEN pct > 15 THEN 'largest' WHEN pct > 7 THEN 'major' WHEN pct > 3 THEN 'regular' ELSE 'specialist' END AS band FROM dist")
def _(spark, sf):
    return _dist_all(spark, sf).select("topic_id", C.topic_size_band(F.col("pct")).alias("band"))


@query("top3_share", f"""WITH {DIST}, t AS (SELECT * FROM dist ORDER BY n DESC, topic_id LIMIT 3)
  SELECT string_agg(CAST(topic_id AS VARCHAR), ', ' ORDER BY n DESC, topic_id) AS topics, round(sum(round(pct, 1)), 1) AS combined_pct FROM t""")
def _(spark, sf):
    return topics.top3_share(_dist(spark, sf))


@query("group_share", """SELECT source, lang, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(topics.group_share(docs(spark, sf), ["source", "lang"]), "pct")


@query("sub_type_listing", """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
  SELECT lang, CAST(sum(n) AS BIGINT) AS n, string_agg(source || ' (' || n || ')', ', ' ORDER BY n DESC, source) AS labels FROM c GROUP BY 1""")
def _(spark, sf):
    return topics.sub_type_listing(docs(spark, sf), "lang", "source")


MEMBER = f"""{CENT}, e AS (SELECT u.task_id, c.topic_id, exp(list_dot_product(u.u, c.c)) AS e FROM unit u, cent c),
member AS (SELECT task_id, topic_id, e / sum(e) OVER (PARTITION BY task_id) AS prob FROM e)"""


@query("soft_membership", f"WITH {MEMBER} SELECT task_id, topic_id, round(prob, 6) AS prob FROM member")
def _(spark, sf):
    return rounded(_member(spark, sf), "prob")


_CONF = f"""{MEMBER}, best AS (SELECT task_id, max(prob) AS best FROM member GROUP BY 1),
conf AS (SELECT topic_id, avg(best) AS p FROM vec JOIN best USING (task_id) GROUP BY 1)"""
_LOW, _HIGH = 0.1445, 0.147


@query("membership_confidence", f"""WITH {_CONF} SELECT topic_id, round(p, 6) AS avg_probability, CASE WHEN p < {_LOW} THEN 'LOW CONFIDENCE' ELSE 'OK' END AS flag,
  CASE WHEN p < {_LOW} THEN 'LOW' WHEN p > {_HIGH} THEN 'HIGH' ELSE 'OK' END AS confidence FROM conf""")
def _(spark, sf):
    return rounded(_confidence(spark, sf), "avg_probability")


def _confidence(spark, sf):
    return topics.membership_confidence(assignment(spark, sf), _best(spark, sf), _LOW, _HIGH)


@query("confidence_distribution", f"""WITH {_CONF}, b AS (SELECT CASE WHEN p < {_LOW} THEN 'LOW' WHEN p > {_HIGH} THEN 'HIGH' ELSE 'OK' END AS confidence FROM conf)
  SELECT confidence, CAST(count(*) AS BIGINT) AS topics, round(count(*) * 100.0 / (SELECT count(*) FROM b), 6) AS pct FROM b GROUP BY 1""")
def _(spark, sf):
    return rounded(topics.confidence_distribution(_confidence(spark, sf)), "pct")


# ------------------------------------------------------ outliers, memberships


def _with_outliers(spark, sf):
    """Every fifth vector counts as an outlier."""
    return assignment(spark, sf).withColumn("topic_id", F.when(order_key() % 5 == 0, F.lit(-1)).otherwise(F.col("topic_id")).cast("bigint"))


_OUT = f"""{MEMBER}, assigned AS (SELECT task_id, CASE WHEN CAST(task_id AS BIGINT) % 5 = 0 THEN -1 ELSE topic_id END AS topic_id FROM vec),
top AS (SELECT task_id, arg_max(topic_id, (round(prob, 12), -topic_id)) AS best FROM member GROUP BY 1)"""


@query("reassign_outliers", f"""WITH {_OUT} SELECT task_id, CAST(CASE WHEN a.topic_id = -1 THEN best ELSE a.topic_id END AS BIGINT) AS topic_id, a.topic_id = -1 AS reassigned
  FROM assigned a JOIN top USING (task_id)""")
def _(spark, sf):
    return cluster.reassign_outliers(_with_outliers(spark, sf), _best(spark, sf))


@query("outlier_rate", f"WITH {_OUT}, r AS (SELECT count(*) FILTER (topic_id = -1) AS o, count(*) AS n FROM assigned) SELECT CAST(n AS BIGINT) AS docs, CAST(o AS BIGINT) AS outliers, round(o * 100.0 / n, 6) AS outlier_pct, o / n < 0.2 AS target_met FROM r")
def _(spark, sf):
    return rounded(cluster.outlier_rate(_with_outliers(spark, sf)), "outlier_pct")


@query("binary_confidence", f"""WITH {_OUT}, best AS (SELECT task_id, max(prob) AS p FROM member GROUP BY 1)
  SELECT task_id, CASE WHEN CAST(task_id AS BIGINT) % 3 = 0 THEN round(p, 4) WHEN topic_id = -1 THEN 0.0 ELSE 1.0 END AS confidence FROM assigned JOIN best USING (task_id)""")
def _(spark, sf):
    joined = _with_outliers(spark, sf).join(_best(spark, sf), "task_id")
    strength = F.when(order_key() % 3 == 0, F.col("best_prob"))
    return joined.select("task_id", cluster.binary_confidence(strength, F.col("topic_id")).alias("confidence"))


_SEEDS = f"{CENT}, sims AS (SELECT u.task_id, c.topic_id, list_dot_product(u.u, c.c) AS sim FROM unit u, cent c)"


@query("zero_shot_assign", f"""WITH {_SEEDS}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round(sim, 9) DESC, topic_id) AS r FROM sims)
  SELECT task_id, CASE WHEN sim >= 0.3 THEN topic_id END AS seed_id, round(sim, 6) AS sim FROM r WHERE r = 1""")
def _(spark, sf):
    seeds = _cent(spark, sf).select(F.col("topic_id").alias("seed_id"), F.col("centroid").alias("embedding"))
    return rounded(cluster.zero_shot_assign(vectors(spark, sf), seeds), "sim")


# ----------------------------------------------- centres, similarity, coherence


@query("topic_centroid", f"WITH {CENT} SELECT topic_id, CAST(i - 1 AS BIGINT) AS pos, round(m, 6) AS value FROM cent_e")
def _(spark, sf):
    return _cent(spark, sf).select("topic_id", F.posexplode("centroid").alias("pos", "value")).select(
        "topic_id", F.col("pos").cast("bigint").alias("pos"), F.round("value", 6).alias("value"))


_SIMS = f"{CENT}, sm AS (SELECT a.topic_id AS a, b.topic_id AS b, list_dot_product(a.c, b.c) AS sim FROM cent a, cent b)"


@query("similarity_matrix", f"WITH {_SIMS} SELECT a, b, round(sim, 6) AS sim FROM sm")
def _(spark, sf):
    return rounded(topics.similarity_matrix(_cent(spark, sf)), "sim")


def _pairs(spark, sf, keywords=None):
    return topics.topic_similarity_pairs(_cent(spark, sf), MIN_SIM, MERGE_SIM, keywords)


@query("topic_similarity_pairs", f"""WITH {_SIMS}, {TERMS.replace(VEC + ', ', '')}, kw AS (SELECT topic_id, string_agg(term, ', ' ORDER BY rank) AS k FROM terms WHERE rank <= 4 GROUP BY 1)
  SELECT a AS topic_a, b AS topic_b, round(sim, 6) AS similarity, CASE WHEN sim > {MERGE_SIM} THEN 'MERGE' ELSE 'CONSIDER' END AS recommendation,
  x.k AS keywords_a, y.k AS keywords_b FROM sm JOIN kw x ON x.topic_id = a JOIN kw y ON y.topic_id = b WHERE a < b AND sim > {MIN_SIM}""")
def _(spark, sf):
    keywords = features.joined_terms(_terms(spark, sf), k=4)
    return rounded(_pairs(spark, sf, keywords), "similarity")


@query("merge_partners", f"""WITH {_SIMS} SELECT a AS topic_id, string_agg(CAST(b AS VARCHAR), '|' ORDER BY round(sim, 9) DESC, b) AS merge_with FROM sm
  WHERE a <> b AND sim > {MIN_SIM} GROUP BY 1""")
def _(spark, sf):
    return topics.merge_partners(_pairs(spark, sf))


_NAMED = "'T' || CAST(topic_id AS VARCHAR)"


@query("merge_candidates_by_distance", f"""WITH {_SIMS}, {_TOP_WORDS.replace(VEC + ', ', '')}, w AS (SELECT topic_id, list(term ORDER BY rank) AS w FROM top_words WHERE rank <= 10 GROUP BY 1),
  p AS (SELECT 'T' || a AS a, 'T' || b AS b, sim, x.w AS wa, y.w AS wb FROM sm JOIN w x ON x.topic_id = a JOIN w y ON y.topic_id = b WHERE 'T' || a < 'T' || b AND sim > 1 - {MAX_DIST})
  SELECT a AS class_a, b AS class_b, round(1 - sim, 6) AS cosine_distance, round(sim, 6) AS cosine_similarity, array_to_string(wa[1:8], ', ') AS words_a,
  array_to_string(wb[1:8], ', ') AS words_b, COALESCE(array_to_string(list_sort(list_intersect(wa, wb))[1:6], ', '), '') AS word_overlap,
  round(len(list_intersect(wa, wb)) * 100.0 / len(list_distinct(list_concat(wa, wb))), 6) AS overlap_pct FROM p""")
def _(spark, sf):
    named = F.concat(F.lit("T"), F.col("topic_id").cast("string"))
    cent = _cent(spark, sf).select(named.alias("label"), "centroid")
    top = _top_words(spark, sf).select(named.alias("label"), "rank", "term")
    return rounded(topics.merge_candidates_by_distance(cent, top, MAX_DIST), "cosine_distance", "cosine_similarity", "overlap_pct")


@query("merge_components", f"""WITH RECURSIVE {_SIMS}, link AS (SELECT a, b FROM sm WHERE a = b OR sim > {MERGE_SIM}),
  reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
  SELECT a AS topic_id, min(b) AS component FROM reach GROUP BY 1""")
def _(spark, sf):
    merge = _pairs(spark, sf).filter("recommendation = 'MERGE'")
    return topics.merge_components(merge, assignment(spark, sf).select("topic_id").distinct(), "topic_a", "topic_b", "topic_id")


_COH = f"""{UNIT}, pairs_ AS (SELECT a.topic_id, avg(list_dot_product(a.u, b.u)) AS coherence FROM unit a JOIN unit b ON a.topic_id = b.topic_id AND a.task_id <> b.task_id GROUP BY 1),
sizes AS (SELECT topic_id, count(*) AS n FROM vec GROUP BY 1),
coh AS (SELECT topic_id, n, COALESCE(coherence, 0.0) AS coherence FROM sizes LEFT JOIN pairs_ USING (topic_id))"""


@query("topic_coherence", f"WITH {_COH} SELECT topic_id, CAST(n AS BIGINT) AS n, round(coherence, 6) AS coherence FROM coh")
def _(spark, sf):
    return rounded(topics.topic_coherence(assignment(spark, sf), vectors(spark, sf)), "coherence")


@query("coherence_band", f"WITH {_COH} SELECT topic_id, CASE WHEN coherence < 0.002 THEN 'LOW' WHEN coherence < 0.004 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM coh")
def _(spark, sf):
    out = topics.topic_coherence(assignment(spark, sf), vectors(spark, sf))
    return out.select("topic_id", C.coherence_band(F.col("coherence"), 0.002, 0.004).alias("band"))


OWN = f"{CENT}, own AS (SELECT u.task_id, u.topic_id, list_dot_product(u.u, c.c) AS sim FROM unit u JOIN cent c USING (topic_id))"


@query("misfit_docs", f"""WITH {OWN}, {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(sim, 9), task_id) AS rank, count(*) OVER (PARTITION BY topic_id) AS n FROM own)
  SELECT topic_id, rank, task_id, round(sim, 6) AS sim, substring(text, 1, 120) AS text FROM r JOIN docs USING (task_id)
  WHERE n >= 10 AND rank <= greatest(1, least(5, floor(n * 5 / 100)))""")
def _(spark, sf):
    return rounded(topics.misfit_docs(assignment(spark, sf), vectors(spark, sf), docs(spark, sf), text="text"), "sim")


_REPS = f"""{OWN}, {TASKS}, nm AS (SELECT o.topic_id, t.name, o.task_id, sim, row_number() OVER (PARTITION BY o.topic_id, t.name ORDER BY round(sim, 9) DESC, o.task_id) AS k
  FROM own o JOIN tasks t USING (task_id) WHERE t.name <> ''),
reps AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY round(sim, 9) DESC, task_id) AS rank FROM nm WHERE k = 1)"""


def _reps(spark, sf):
    return cluster.representative_docs(assignment(spark, sf), vectors(spark, sf), tasks(spark, sf))


@query("representative_docs", f"""WITH {_REPS}, places AS (SELECT DISTINCT topic_id, r.rank FROM own, range(1, 4) r(rank))
  SELECT topic_id, CAST(p.rank AS BIGINT) AS rank, task_id, COALESCE(name, '') AS name, round(sim, 6) AS sim FROM places p LEFT JOIN reps USING (topic_id, rank)""")
def _(spark, sf):
    return rounded(_reps(spark, sf), "sim")


@query("silhouette", f"""WITH {UNIT}, n AS (SELECT topic_id, count(*) AS n FROM unit GROUP BY 1),
  d AS (SELECT a.task_id, a.topic_id AS own, b.topic_id AS other, sum(1 - list_dot_product(a.u, b.u)) AS s FROM unit a, unit b WHERE a.task_id <> b.task_id GROUP BY ALL),
  ab AS (SELECT task_id, max(CASE WHEN own = other THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d JOIN n ON n.topic_id = other GROUP BY 1)
  SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab""")
def _(spark, sf):
    return rounded(cluster.silhouette(assignment(spark, sf), vectors(spark, sf)), "silhouette")


# -------------------------------------------------------------------- samples


@query("topic_samples", f"""WITH {_TOPIC_DOCS} SELECT topic_id, rank, task_id, substring(text, 1, 200) AS text FROM (SELECT *,
  row_number() OVER (PARTITION BY topic_id ORDER BY CAST(task_id AS BIGINT)) AS rank FROM td) WHERE rank <= 50""")
def _(spark, sf):
    return topics.topic_samples(topic_docs(spark, sf), "topic_id", [order_key()], text="text")


@query("random_sample_per_group", f"""WITH {DOCS} SELECT source, task_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(task_id || ':42'), task_id) AS rank FROM docs)
  WHERE rank <= 3""")
def _(spark, sf):
    return topics.random_sample_per_group(docs(spark, sf), ["source"], 3).select("source", "task_id", "rank")


@query("summary_pack", f"""WITH {DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CAST(task_id AS BIGINT)) AS rank FROM docs)
  SELECT source, CAST(count(*) AS BIGINT) AS n, min(lang) AS lang, string_agg(rank || '. ' || CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END, chr(10) ORDER BY rank) FILTER (rank <= 40) AS body,
  CAST(count(*) FILTER (rank <= 40) AS BIGINT) AS shown FROM r GROUP BY 1""")
def _(spark, sf):
    return topics.summary_pack(docs(spark, sf), "source", [order_key()], "lang", "text")


# ---------------------------------------------------------- platforms, crosstabs


@query("platform_distribution", """SELECT lang, source, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY lang), 6) AS pct FROM documents GROUP BY 1, 2""")
def _(spark, sf):
    return rounded(topics.platform_distribution(docs(spark, sf), "source", "lang"), "pct")


@query("platform_distribution_overall", "SELECT source, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY 1")
def _(spark, sf):
    return rounded(topics.platform_distribution(docs(spark, sf), "source"), "pct")


_DOMINANT = f"""{_TOPIC_DOCS}, pc AS (SELECT topic_id, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY topic_id) AS total FROM td GROUP BY 1, 2),
dominant AS (SELECT topic_id, lang AS dominant, n / total AS dominant_share FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, lang) AS r FROM pc) WHERE r = 1)"""


@query("dominant_platform", f"WITH {_DOMINANT} SELECT topic_id, dominant, round(dominant_share, 6) AS dominant_share FROM dominant")
def _(spark, sf):
    return rounded(topics.dominant_platform(topic_docs(spark, sf), "lang"), "dominant_share")


_LANGS = ["de", "en", "es", "fr"]


@query("crosstab_topic_platform", f"WITH {TASKS} SELECT CAST(t.topic_id AS BIGINT) AS topic_id, " + ", ".join(
    f"CAST(count(*) FILTER (d.lang = '{x}') AS BIGINT) AS {x}" for x in _LANGS) + " FROM tasks t JOIN documents d ON CAST(d.doc_id AS VARCHAR) = t.task_id GROUP BY 1")
def _(spark, sf):
    joined = tasks(spark, sf).select("task_id", F.col("topic_id").cast("bigint").alias("topic_id")).join(docs(spark, sf).select("task_id", "lang"), "task_id")
    return topics.crosstab_topic_platform(joined, "topic_id", "lang", _LANGS)


_TAGS = f"{TASKS}, tg AS (SELECT platform AS tag, CAST(topic_id AS BIGINT) AS topic_id FROM tasks WHERE platform <> '')"


def _tagged(spark, sf):
    return tasks(spark, sf).select("task_id", F.col("platform").alias("tag"), F.col("topic_id").cast("bigint").alias("topic_id"))


@query("crosstab_top_labels", f"""WITH {_TAGS}, c AS (SELECT topic_id, tag, count(*) AS n FROM tg GROUP BY 1, 2)
  SELECT topic_id, rank, tag, CAST(n AS BIGINT) AS n, round(pct, 6) AS pct FROM (SELECT *, n * 100.0 / sum(n) OVER (PARTITION BY topic_id) AS pct,
  row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, tag) AS rank FROM c) WHERE rank <= 5""")
def _(spark, sf):
    return rounded(topics.crosstab_top_labels(_tagged(spark, sf), "tag", "topic_id"), "pct")


@query("topics_of_top_tags", f"""WITH {_TAGS}, b AS (SELECT tag, count(*) AS m FROM tg GROUP BY 1 ORDER BY m DESC, tag LIMIT 15), c AS (SELECT tag, topic_id, count(*) AS n FROM tg GROUP BY 1, 2)
  SELECT tag, rank, topic_id, CAST(n AS BIGINT) AS n, round(pct, 6) AS pct FROM (SELECT c.*, n * 100.0 / m AS pct, row_number() OVER (PARTITION BY tag ORDER BY n DESC, topic_id) AS rank
  FROM c JOIN b USING (tag)) WHERE rank <= 3""")
def _(spark, sf):
    return rounded(topics.topics_of_top_tags(_tagged(spark, sf), "tag", "topic_id"), "pct")


@query("tag_topic_counts", f"""WITH {_TAGS}, b AS (SELECT tag FROM tg GROUP BY 1 ORDER BY count(*) DESC, tag LIMIT 10)
  SELECT tag, topic_id, CAST(count(*) AS BIGINT) AS n FROM tg WHERE tag IN (SELECT tag FROM b) GROUP BY 1, 2""")
def _(spark, sf):
    return topics.tag_topic_counts(_tagged(spark, sf), "tag", "topic_id")


# ------------------------------------------------------------- text per label

_ACTIONS = {"Articles": ["the ", "une ", "das "], "Digits": ["1", "2", "3"], "Marks": ["***", "###"]}


@query("action_mix", "WITH " + DOCS + " " + " UNION ALL ".join(
    f"SELECT lang, '{a}' AS action, round(count(*) FILTER ({' OR '.join(f'contains(lower(text), {lit(w)})' for w in ws)}) * 100.0 / count(*), 6) AS pct FROM docs GROUP BY 1" for a, ws in _ACTIONS.items()))
def _(spark, sf):
    return rounded(topics.action_mix(texts(spark, sf), "lang", _ACTIONS, "text"), "pct")


@query("text_metrics", f"""WITH {DOCS}, w AS (SELECT source, {words('text')} AS w, length(text) AS c FROM docs),
  r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY w) AS r, count(*) OVER (PARTITION BY source) AS n FROM w)
  SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(w), 6) AS avg_words, CAST(max(CASE WHEN r = n // 2 + 1 THEN w END) AS BIGINT) AS median_words,
  CAST(max(c) AS BIGINT) AS max_chars, CAST(min(c) AS BIGINT) AS min_chars, round(avg(c), 6) AS avg_chars FROM r GROUP BY 1""")
def _(spark, sf):
    return rounded(topics.text_metrics(texts(spark, sf), "text", "source"), "avg_words", "avg_chars")


@query("xy_centroids", f"WITH {VEC} SELECT topic_id, round(avg(x[1]), 6) AS x, round(avg(x[2]), 6) AS y, CAST(count(*) AS BIGINT) AS n FROM vec GROUP BY 1")
def _(spark, sf):
    points = assignment(spark, sf).join(vectors(spark, sf), "task_id").select(
        "topic_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return rounded(topics.xy_centroids(points, "topic_id"), "x", "y")


# ------------------------------------------------------------- drafts and rules

_RULES = [("Alpha", "P1", [["=here", "=they"]]), ("Beta", "P2", [["~eder"], ["=ther"]]), ("Gamma", "P1", [["=tion"], ["~the", "~er"]])]
_WORDS = f"{TERMS}, wl AS (SELECT topic_id, list(term ORDER BY rank) AS w FROM terms WHERE rank <= 10 GROUP BY 1)"


def _rule_sql(w, column):
    def part(p):
        return f"list_contains({w}, {lit(p[1:])})" if p[0] == "=" else f"contains(array_to_string({w}, ' '), {lit(p[1:])})"

    whens = " ".join("WHEN " + " OR ".join("(" + " AND ".join(part(p) for p in alt) + ")" for alt in rule[2]) + f" THEN {lit(rule[column])}" for rule in _RULES)
    return f"CASE {whens} END"


def _word_lists(spark, sf):
    return _terms(spark, sf).groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select(
        "topic_id", F.transform("t", lambda x: x["term"]).alias("words"))


_SUGGEST = f"""{_WORDS}, {_DOMINANT.replace(DOCS + ', ' + VEC + ', ', '').replace("td AS (SELECT d.task_id, d.text, d.source, d.lang, v.topic_id FROM docs d JOIN vec v USING (task_id)), ", '')},
sg AS (SELECT topic_id, COALESCE({_rule_sql('w[1:6]', 0)}, 'Topic_' || topic_id) AS nm, dominant, dominant_share FROM wl JOIN dominant USING (topic_id)),
suggested AS (SELECT topic_id, CASE WHEN nm IN ('Beta', 'Gamma') AND dominant_share > 0.6 AND dominant <> 'General' THEN nm || ' (' || dominant || ')' ELSE nm END AS suggested_name FROM sg)"""


def _suggested(spark, sf):
    return topics.suggest_name(_word_lists(spark, sf), _RULES, topics.dominant_platform(topic_docs(spark, sf), "lang"), ["Beta", "Gamma"])


@query("suggest_name", f"WITH {_SUGGEST} SELECT topic_id, suggested_name FROM suggested")
def _(spark, sf):
    return _suggested(spark, sf)


# The test that splits a topic: the words' share stands in for a silhouette here,
# so that the draft can be stated in SQL as well.
_SPLITS = "splits AS (SELECT topic_id, n % 2 = 0 AS split_recommended, n / 1000 AS silhouette FROM dist)"
_DRAFT = f"""{_SUGGEST}, {DIST}, {CENT.replace(VEC + ', ', '')}, e AS (SELECT u.task_id, c.topic_id, exp(list_dot_product(u.u, c.c)) AS e FROM unit u, cent c),
member AS (SELECT task_id, topic_id, e / sum(e) OVER (PARTITION BY task_id) AS prob FROM e),
best AS (SELECT task_id, max(prob) AS best FROM member GROUP BY 1), conf AS (SELECT topic_id, avg(best) AS p FROM vec JOIN best USING (task_id) GROUP BY 1),
sm AS (SELECT a.topic_id AS a, b.topic_id AS b, list_dot_product(a.c, b.c) AS sim FROM cent a, cent b),
mp AS (SELECT a AS topic_id, string_agg(CAST(b AS VARCHAR), '|' ORDER BY round(sim, 9) DESC, b) AS merge_with FROM sm WHERE a <> b AND sim > {MIN_SIM} GROUP BY 1),
{_COH.replace(UNIT + ', ', '')}, {_SPLITS},
draft AS (SELECT dist.topic_id, substring(array_to_string(w, ', '), 1, 50) AS current_label, suggested_name, CAST(dist.n AS BIGINT) AS doc_count, round(pct, 1) AS pct,
  round(coherence, 3) AS coherence, CASE WHEN p < {_LOW} THEN 'LOW' WHEN p > {_HIGH} THEN 'HIGH' ELSE 'OK' END AS confidence, round(p, 4) AS avg_probability,
  split_recommended, round(silhouette, 3) AS split_silhouette, COALESCE(merge_with, '') AS merge_with
  FROM dist JOIN wl USING (topic_id) JOIN suggested USING (topic_id) JOIN coh USING (topic_id) JOIN conf USING (topic_id) JOIN splits USING (topic_id) LEFT JOIN mp USING (topic_id))"""


def _draft(spark, sf):
    dist = _dist(spark, sf)
    splits = dist.select("topic_id", (F.col("n") % 2 == 0).alias("split_recommended"), (F.col("n") / 1000).alias("silhouette"))
    return topics.taxonomy_draft(dist, features.joined_terms(_terms(spark, sf)), _suggested(spark, sf),
                                 topics.topic_coherence(assignment(spark, sf), vectors(spark, sf)), _confidence(spark, sf), splits,
                                 topics.merge_partners(_pairs(spark, sf)))


@query("taxonomy_draft", f"WITH {_DRAFT} SELECT * FROM draft")
def _(spark, sf):
    return _draft(spark, sf)


_PASS = f"""{_DRAFT}, ps AS (SELECT topic_id, COALESCE({_rule_sql("string_split(current_label, ', ')[1:8]", 0)}, 'Unclassified (Topic ' || topic_id || ')') AS business_name,
  COALESCE({_rule_sql("string_split(current_label, ', ')[1:8]", 1)}, 'Uncategorized') AS business_pillar, confidence <> 'LOW' AS label_valid,
  array_to_string(list_filter([CASE WHEN confidence = 'LOW' THEN {lit(K.NOTE_LOW_CONFIDENCE)} END, CASE WHEN coherence < 0.25 THEN {lit(K.NOTE_LOW_COHERENCE)} END,
    CASE WHEN split_recommended THEN printf({lit(K.NOTE_SPLIT)}, split_silhouette) END,
    CASE WHEN merge_with <> '' THEN {lit(K.NOTE_MERGE)} || array_to_string(string_split(merge_with, '|')[1:3], ', ') END], lambda x: x IS NOT NULL), '; ') AS notes FROM draft),
passport AS (SELECT * REPLACE (CASE WHEN notes = '' THEN {lit(K.NOTE_NONE)} ELSE notes END AS notes) FROM ps)"""


def _passport(draft):
    return topics.classify_passport(draft, _RULES)


@query("classify_passport", f"WITH {_PASS} SELECT * FROM passport")
def _(spark, sf):
    return _passport(_draft(spark, sf))


_FINAL = f"""{_PASS}, final AS (SELECT topic_id, business_pillar, business_name, doc_count, pct, coherence, confidence, label_valid, notes, merge_with, split_recommended,
  CASE WHEN confidence <> 'LOW' AND merge_with = '' AND NOT split_recommended THEN 'APPROVED' ELSE 'REVIEW' END AS action FROM draft JOIN passport USING (topic_id))"""


def _final(spark, sf):
    draft = _draft(spark, sf).persist()
    return topics.final_taxonomy(draft, _passport(draft))


@query("final_taxonomy", f"WITH {_FINAL} SELECT * FROM final")
def _(spark, sf):
    return _final(spark, sf)


@query("action_text", f"""WITH {_FINAL} SELECT topic_id, CASE WHEN merge_with <> '' THEN 'Consider merge with [' || array_to_string(string_split(merge_with, '|')[1:2], ', ') || ']'
  WHEN split_recommended THEN 'Consider split' WHEN confidence = 'LOW' THEN 'Review - low confidence' ELSE 'Approved' END AS action FROM final""")
def _(spark, sf):
    final = _final(spark, sf)
    return final.select("topic_id", topics.action_text(final).alias("action"))


@query("pillar_rollup", f"""WITH {_FINAL} SELECT business_pillar, CAST(count(*) AS BIGINT) AS topics, CAST(sum(doc_count) AS BIGINT) AS n,
  round(sum(doc_count) * 100.0 / (SELECT sum(doc_count) FROM final), 6) AS pct FROM final GROUP BY 1""")
def _(spark, sf):
    return rounded(topics.pillar_rollup(_final(spark, sf)), "pct")


@query("pillar_platform_heatmap", f"""WITH {_FINAL}, cell AS (SELECT business_pillar, platform, count(*) AS n FROM tasks t JOIN final f ON f.topic_id = t.topic_id GROUP BY 1, 2),
  tot AS (SELECT business_pillar, sum(doc_count) AS total FROM final GROUP BY 1)
  SELECT business_pillar, platform, CAST(n AS BIGINT) AS n, CAST(least(255, floor(n / greatest(total, 1) * 400)) AS BIGINT) AS intensity FROM cell JOIN tot USING (business_pillar)""")
def _(spark, sf):
    counts = tasks(spark, sf).groupBy(F.col("topic_id").cast("bigint").alias("topic_id"), "platform").agg(F.count("*").alias("n"))
    return topics.pillar_platform_heatmap(_final(spark, sf), counts, "platform")


@query("scorecard", f"""WITH {_FINAL}, f AS (SELECT count(DISTINCT business_pillar) AS p, count(*) AS t, round(avg(coherence), 3) AS c, avg(coherence) AS cr, count(*) FILTER (confidence = 'HIGH') AS h,
  count(*) FILTER (split_recommended) AS s, (SELECT count(*) FROM tasks) AS total, sum(doc_count) AS covered, (SELECT count(*) FROM sm WHERE a < b AND sim > {MERGE_SIM}) AS m FROM final)
  SELECT 'Total Tasks' AS metric, CAST(total AS VARCHAR) AS value, 'PASS' AS status FROM f UNION ALL SELECT 'Business Pillars', CAST(p AS VARCHAR), 'PASS' FROM f
  UNION ALL SELECT 'Topic Clusters', CAST(t AS VARCHAR), 'PASS' FROM f
  UNION ALL SELECT 'Outlier Rate', CAST(round((total - covered) * 100.0 / total, 1) AS VARCHAR) || '%', CASE WHEN (total - covered) / total < 0.2 THEN 'PASS' ELSE 'REVIEW' END FROM f
  UNION ALL SELECT 'Avg Coherence', CAST(c + 0.0 AS VARCHAR), CASE WHEN cr > 0.3 THEN 'GOOD' ELSE 'MODERATE' END FROM f
  UNION ALL SELECT 'High Confidence Topics', h || '/' || t, 'GOOD' FROM f UNION ALL SELECT 'Merge Candidates', CAST(m AS VARCHAR), 'PENDING' FROM f
  UNION ALL SELECT 'Split Candidates', CAST(s AS VARCHAR), 'PENDING' FROM f""")
def _(spark, sf):
    return topics.scorecard(_final(spark, sf), _pairs(spark, sf), topics.total_rows(tasks(spark, sf)))


_PRUNE = f"""{_DRAFT}, noise AS (SELECT dist.topic_id AS topic, dist.n, CASE WHEN p < {_LOW} THEN printf('Low confidence (avg_prob=%.3f)', p)
  WHEN dist.n < 45 THEN printf('Very small cluster (%d docs)', dist.n) END AS reason FROM dist LEFT JOIN conf USING (topic_id)),
prop AS (SELECT 'NOISE' AS kind, topic, NULL AS other, CAST(n AS BIGINT) AS n, reason FROM noise WHERE reason IS NOT NULL
  UNION ALL SELECT 'MERGE', a, b, NULL, printf('Similarity %.4f', sim) FROM sm WHERE a < b AND sim > {MIN_SIM})"""


def _proposal(spark, sf):
    return topics.prune_proposal(_dist(spark, sf), _confidence(spark, sf), _pairs(spark, sf), 45)


@query("prune_proposal", f"WITH {_PRUNE} SELECT * FROM prop")
def _(spark, sf):
    return _proposal(spark, sf)


@query("prune_totals", f"""WITH {_PRUNE}, a AS (SELECT count(*) FILTER (kind = 'NOISE') AS nt, COALESCE(sum(n), 0) AS nd, count(*) FILTER (kind = 'MERGE') AS mp FROM prop)
  SELECT CAST(nt AS BIGINT) AS noise_topics, CAST(nd AS BIGINT) AS noise_docs, CAST(mp AS BIGINT) AS merge_pairs, round(nd * 100.0 / (SELECT count(*) FROM tasks), 6) AS noise_pct,
  CAST((SELECT count(*) FROM dist) - nt AS BIGINT) AS kept_topics FROM a""")
def _(spark, sf):
    return rounded(topics.prune_totals(_dist(spark, sf), _proposal(spark, sf), topics.total_rows(tasks(spark, sf))), "noise_pct")


_KW = ", ".join(f"COALESCE(max(CASE WHEN rank = {r} THEN term END), '') AS kw_{r:02d}, COALESCE(max(CASE WHEN rank = {r} THEN round(score, 6) END), 0.0) AS ctfidf_{r:02d}" for r in range(1, 11))


@query("topic_explanations", f"""WITH {TERMS}, {DIST_ALL}, {_REPS.replace(VEC + ', ', '').replace(', ' + TASKS, '')}, wide AS (SELECT topic_id, {_KW} FROM terms WHERE rank <= 10 GROUP BY 1),
  smp AS (SELECT topic_id, max(CASE WHEN rank = 1 THEN name END) AS s1, max(CASE WHEN rank = 2 THEN name END) AS s2, max(CASE WHEN rank = 3 THEN name END) AS s3 FROM reps GROUP BY 1),
  lb AS (SELECT topic_id, string_agg(term, ' | ' ORDER BY rank) AS l FROM terms WHERE rank <= 3 GROUP BY 1), tot AS (SELECT sum(n) AS t, sum(n) FILTER (topic_id <> -1) AS c FROM dist)
  SELECT d.topic_id, CASE WHEN d.topic_id = -1 THEN 'outlier' ELSE COALESCE(l, '') END AS topic_label, CAST(n AS BIGINT) AS topic_size, round(n * 100.0 / t, 2) AS pct_of_total,
  CASE WHEN d.topic_id = -1 THEN 0.0 ELSE round(n * 100.0 / c, 2) END AS pct_of_classified, {', '.join(f"COALESCE(kw_{r:02d}, '') AS kw_{r:02d}, COALESCE(ctfidf_{r:02d}, 0.0) AS ctfidf_{r:02d}" for r in range(1, 11))},
  COALESCE(s1, '') AS sample_name_1, COALESCE(s2, '') AS sample_name_2, COALESCE(s3, '') AS sample_name_3
  FROM dist d CROSS JOIN tot LEFT JOIN wide USING (topic_id) LEFT JOIN smp USING (topic_id) LEFT JOIN lb USING (topic_id)""")
def _(spark, sf):
    return topics.topic_explanations(_terms(spark, sf), _dist_all(spark, sf), _reps(spark, sf))
