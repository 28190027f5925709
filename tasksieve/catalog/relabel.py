"""Taxonomy transforms over the given tasks and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasksieve.catalog.base import TASKS, UNIT, VEC, assignment, lit, query, vectors
from tasksieve.catalog.topics import rounded
from tasksieve.operators import taxonomy
from tasksieve.operators.classify import align_features
from tasksieve.sources.tables import tasks

MERGES = {0: [3, 7], 2: [5]}
NAMES = {0: ("Accounts", "Setup"), 1: ("Reports", "Portal"), 2: ("Reports", "Billing"), 4: ("Data", "Cost Basis"), 6: ("Data", "Feeds"),
         8: ("Accounts", "Transfers")}
RENAMES = {"Setup": "Account Setup", "Billing": "Invoices", "Absent": "Nothing"}
PILLARS = {"Portal": "Client Reporting", "Feeds": "Data Quality"}


def _base(spark, sf):
    return tasks(spark, sf).select("task_id", F.col("topic_id").cast("bigint").alias("topic_id"), "platform")


_T = f"{TASKS}, base AS (SELECT task_id, CAST(topic_id AS BIGINT) AS topic_id, platform FROM tasks)"
_MERGED = f"{_T}, merged AS (SELECT task_id, CASE WHEN topic_id IN (3, 7) THEN 0 WHEN topic_id = 5 THEN 2 ELSE topic_id END AS topic_id, platform FROM base)"
_V = ", ".join(f"({t}, {lit(p)}, {lit(n)})" for t, (p, n) in NAMES.items())
_NAMED = f"""{_MERGED}, nm(topic_id, p, l) AS (VALUES {_V}), named AS (SELECT m.*, COALESCE(p, 'Unknown') AS business_pillar, COALESCE(l, 'Unknown') AS label
  FROM merged m LEFT JOIN nm USING (topic_id))"""


@query("apply_topic_merges", f"WITH {_MERGED} SELECT * FROM merged")
def _(spark, sf):
    return taxonomy.apply_topic_merges(_base(spark, sf), MERGES)


def _named(spark, sf):
    return taxonomy.apply_name_map(taxonomy.apply_topic_merges(_base(spark, sf), MERGES), NAMES)


@query("apply_name_map", f"WITH {_NAMED} SELECT * FROM named")
def _(spark, sf):
    return _named(spark, sf)


_RENAMED = "CASE label " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in RENAMES.items()) + " ELSE label END"


@query("rename_labels", f"WITH {_NAMED} SELECT task_id, topic_id, platform, business_pillar, {_RENAMED} AS label FROM named")
def _(spark, sf):
    return taxonomy.rename_labels(_named(spark, sf), RENAMES)


@query("rename_hits", f"WITH {_NAMED}, r(old, new) AS (VALUES {', '.join(f'({lit(a)}, {lit(b)})' for a, b in RENAMES.items())}) "
       "SELECT old, new, CAST((SELECT count(*) FROM named WHERE label = old) AS BIGINT) AS n FROM r")
def _(spark, sf):
    return taxonomy.rename_hits(_named(spark, sf), RENAMES)


_OVERRIDDEN = "CASE label " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in PILLARS.items()) + " ELSE business_pillar END"


@query("override_pillars", f"WITH {_NAMED} SELECT task_id, topic_id, platform, label, {_OVERRIDDEN} AS business_pillar FROM named")
def _(spark, sf):
    return taxonomy.override_pillars(_named(spark, sf), PILLARS)


@query("label_distribution", f"""WITH {_NAMED}, c AS (SELECT label, count(*) AS n FROM named GROUP BY 1)
  SELECT label, CAST(n AS BIGINT) AS n, round(n * 100.0 / (SELECT count(*) FROM named), 6) AS pct, n = (SELECT min(n) FROM c) AS is_min FROM c""")
def _(spark, sf):
    return rounded(taxonomy.label_distribution(_named(spark, sf)), "pct")


@query("label_to_pillar", f"""WITH {_NAMED} SELECT platform, arg_min(business_pillar, CAST(task_id AS BIGINT)) AS business_pillar, CAST(count(DISTINCT business_pillar) AS BIGINT) AS n_pillars
  FROM named GROUP BY 1""")
def _(spark, sf):
    return taxonomy.label_to_pillar(_named(spark, sf), F.col("task_id").cast("bigint"), "platform")


# --------------------------------------------------------- nearest neighbours

_LABELS = "'T' || CAST(topic_id AS VARCHAR)"
_KNN = f"""{UNIT}, near AS (SELECT q.task_id, {_LABELS.replace('topic_id', 'p.topic_id')} AS label, list_dot_product(q.u, p.u) AS sim, p.task_id AS nid
  FROM unit q JOIN unit p ON q.topic_id = 3 AND p.topic_id <> 3),
k7 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round(sim, 9) DESC, nid) AS rank FROM near) WHERE rank <= 7),
votes AS (SELECT task_id, label, count(*) AS v, min(rank) AS f, avg(sim) AS s FROM k7 GROUP BY 1, 2),
win AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY v DESC, f) AS r FROM votes),
res AS (SELECT task_id, label AS proposed_class, v / 7 AS confidence, s AS avg_similarity, CASE WHEN v / 7 < 0.3 THEN 'REVIEW' ELSE 'AUTO' END AS flag FROM win WHERE r = 1)"""


def _labels(spark, sf):
    return assignment(spark, sf).select("task_id", F.concat(F.lit("T"), F.col("topic_id").cast("string")).alias("label"))


def _moved(spark, sf, **search):
    return taxonomy.knn_redistribute(vectors(spark, sf), _labels(spark, sf), "T3", min_conf=0.3, **search)


def _voted(moved):
    ballot = F.array_join(F.transform("knn_votes", lambda v: F.concat(v["label"], F.lit("="), v["votes"].cast("string"))), " ")
    return rounded(moved.withColumn("knn_votes", ballot), "confidence", "avg_similarity")


_VOTED = f"""WITH {_KNN}, ballot AS (SELECT task_id, string_agg(label || '=' || v, ' ' ORDER BY v DESC, f) AS knn_votes FROM votes GROUP BY 1)
SELECT task_id, proposed_class, round(confidence, 6) AS confidence, round(avg_similarity, 6) AS avg_similarity, flag, knn_votes FROM res JOIN ballot USING (task_id)"""


@query("knn_redistribute", _VOTED)
def _(spark, sf):
    return _voted(_moved(spark, sf))


@query("knn_redistribute_blocked", _VOTED)
def _(spark, sf):
    """The way taken when neither side is small."""
    return _voted(_moved(spark, sf, small_rows=0, block_rows=64))


@query("redistribution_summary", f"""WITH {_KNN} SELECT proposed_class, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS avg_conf, round(avg(avg_similarity), 6) AS avg_sim,
  CAST(count(*) FILTER (flag = 'REVIEW') AS BIGINT) AS review FROM res GROUP BY 1""")
def _(spark, sf):
    return rounded(taxonomy.redistribution_summary(_moved(spark, sf)), "avg_conf", "avg_sim")


_OVR = f"""{_KNN}, lab AS (SELECT task_id, {_LABELS} AS label, CASE WHEN topic_id % 2 = 0 THEN 'even' ELSE 'odd' END AS business_pillar FROM vec),
manual AS (SELECT task_id, 'T8' AS m FROM res WHERE CAST(task_id AS BIGINT) % 4 = 0),
fresh AS (SELECT l.task_id, COALESCE(m, proposed_class, label) AS label, m IS NOT NULL AS overridden, business_pillar AS old, proposed_class IS NOT NULL AS moved
  FROM lab l LEFT JOIN res USING (task_id) LEFT JOIN manual USING (task_id)),
done AS (SELECT task_id, label, overridden, CASE WHEN NOT moved THEN old WHEN CAST(substr(label, 2) AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END AS business_pillar FROM fresh)"""


def _overridden(spark, sf):
    parity = F.when(F.substring("label", 2, 9).cast("int") % 2 == 0, "even").otherwise("odd")
    labels = _labels(spark, sf).withColumn("business_pillar", parity)
    moved = _moved(spark, sf).persist()
    manual = moved.filter(F.col("task_id").cast("bigint") % 4 == 0).select("task_id", F.lit("T8").alias("label"))
    pillars = labels.select("label", "business_pillar").distinct()
    return taxonomy.apply_overrides(labels, moved, manual, pillars)


@query("apply_overrides", f"WITH {_OVR} SELECT * FROM done")
def _(spark, sf):
    return _overridden(spark, sf)


@query("override_counts", f"WITH {_OVR} SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (overridden) AS BIGINT) AS overridden FROM done GROUP BY 1")
def _(spark, sf):
    return taxonomy.override_counts(_overridden(spark, sf))


@query("dissolve_label_check", f"WITH {_OVR} SELECT CAST(count(*) FILTER (label = 'T3') AS BIGINT) AS remaining, count(*) FILTER (label = 'T3') = 0 AS ok FROM done")
def _(spark, sf):
    return taxonomy.dissolve_label_check(_overridden(spark, sf), "T3")


@query("align_features", f"WITH {VEC}, {_NAMED} SELECT v.task_id, label, round(x[1], 6) AS first FROM vec v JOIN named n ON n.task_id = v.task_id WHERE label <> 'Unknown'")
def _(spark, sf):
    labels = _named(spark, sf).filter("label <> 'Unknown'").select("task_id", "label")
    return align_features(vectors(spark, sf), labels).select("task_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
