"""Column profiles, coverage, token statistics, trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.catalog.base import DOCS, STOP, TASKS, in_list, lit, query, texts
from tasksieve.functions.conditions import contains_ci
from tasksieve.operators import audit, features, filters, trends
from tasksieve.sources.tables import table, tasks

_COLS = ["name", "notes", "parent_task", "household", "assignee", "issue_type", "platform"]


@query("column_fill_rate", f"WITH {TASKS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER ({c} <> '') AS BIGINT) AS filled, CAST(count(*) FILTER ({c} = '') AS BIGINT) AS empty, "
    f"round(count(*) FILTER ({c} <> '') * 100.0 / count(*), 6) AS pct FROM tasks" for c in _COLS))
def _(spark, sf):
    return audit.column_fill_rate(tasks(spark, sf), [*_COLS, "no_such_column"]).withColumn("pct", F.round("pct", 6))


_MARKS = [("top_level", "parent_task = ''"), ("sub_task", "parent_task <> ''"), ("bot", "contains(lower(name), 'rewh')"),
          ("empty_notes", "notes = ''")]


@query("split_counts", f"WITH {TASKS} " + " UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST(count(*) FILTER ({e}) AS BIGINT) AS n, round(count(*) FILTER ({e}) * 100.0 / count(*), 6) AS pct FROM tasks" for n, e in _MARKS))
def _(spark, sf):
    rules = [("top_level", F.col("parent_task") == ""), ("sub_task", F.col("parent_task") != ""), ("bot", contains_ci(F.col("name"), "Rewh")),
             ("empty_notes", F.col("notes") == "")]
    return audit.split_counts(tasks(spark, sf), rules).withColumn("pct", F.round("pct", 6))


@query("value_distribution", """WITH c AS (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1)
  SELECT value, CAST(n AS BIGINT) AS n, CAST(greatest(1, floor(n / (SELECT max(n) FROM c) * 38)) AS BIGINT) AS bar,
  CAST(greatest((SELECT count(*) FROM c) - 30, 0) AS BIGINT) AS more_values FROM c ORDER BY n DESC, value LIMIT 30""")
def _(spark, sf):
    return audit.value_distribution(table(spark, sf, "part"), "p_type")


@query("length_distribution", f"""WITH {TASKS} SELECT CASE WHEN l <= 0 THEN '0' WHEN l <= 50 THEN '1-50' WHEN l <= 150 THEN '51-150' WHEN l <= 300 THEN '151-300'
  WHEN l <= 600 THEN '301-600' WHEN l <= 1200 THEN '601-1200' ELSE '>1200' END AS bucket, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT length(notes) AS l FROM tasks) GROUP BY 1""")
def _(spark, sf):
    return audit.length_distribution(tasks(spark, sf), "notes")


@query("length_stats", f"""WITH {TASKS} SELECT CAST(min(l) AS BIGINT) AS min_len, CAST(median(l) AS DOUBLE) AS median_len, round(avg(l), 6) AS mean_len,
  CAST(max(l) AS BIGINT) AS max_len FROM (SELECT length(notes) AS l FROM tasks) WHERE l > 0""")
def _(spark, sf):
    return audit.length_stats(tasks(spark, sf), "notes").withColumn("mean_len", F.round("mean_len", 6))


@query("distinct_non_empty", f"WITH {TASKS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) FILTER ({c} <> '') AS BIGINT) AS n_distinct FROM tasks" for c in _COLS))
def _(spark, sf):
    return audit.distinct_non_empty(tasks(spark, sf), _COLS)


@query("coverage_before_after", f"""WITH {TASKS}, p AS (SELECT count(*) AS docs, round(count(*) FILTER (trim(issue_type) <> '') * 100.0 / count(*), 1) AS b,
  round(count(*) FILTER (topic_id <> -1) * 100.0 / count(*), 1) AS a, round(count(*) FILTER (topic_id = -1) * 100.0 / count(*), 1) AS o FROM tasks)
  SELECT CAST(docs AS BIGINT) AS docs, b AS pct_before, a AS pct_after, o AS pct_outlier, round(a - b, 1) AS gain_points FROM p""")
def _(spark, sf):
    return audit.coverage_before_after(tasks(spark, sf), "issue_type")


@query("signal_presence", f"WITH {TASKS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (trim({c}) <> '') AS BIGINT) AS with_text, CAST(count(*) FILTER (trim({c}) = '') AS BIGINT) AS without_text, "
    f"round(count(*) FILTER (trim({c}) <> '') * 100.0 / count(*), 1) AS pct FROM tasks" for c in ("household", "assignee", "issue_type")))
def _(spark, sf):
    return audit.signal_presence(tasks(spark, sf), ["household", "assignee", "issue_type"])


_CHAT = "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS task_id, replace(replace(text, '. ', ':' || chr(10)), ', ', ':' || chr(10)) AS text FROM conversations"


def _chat(spark, sf):
    lines = F.replace(F.replace("text", F.lit(". "), F.lit(":\n")), F.lit(", "), F.lit(":\n"))
    return table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("task_id"), lines.alias("text"))


@query("discover_form_labels", f"""WITH chat AS ({_CHAT}), hits AS (SELECT task_id, unnest(regexp_extract_all(text, {lit('(?m)' + K.FORM_LABEL_LINE)}, 1)) AS label FROM chat)
  SELECT trim(label) AS label, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT task_id) AS BIGINT) AS docs FROM hits GROUP BY 1 ORDER BY n DESC, label LIMIT 20""")
def _(spark, sf):
    return audit.discover_form_labels(_chat(spark, sf), "text")


@query("rows_with_form_labels", f"""WITH chat AS ({_CHAT}) SELECT CAST(count(*) AS BIGINT) AS docs,
  CAST(count(*) FILTER (regexp_matches(text, {lit('(?m)' + K.FORM_LABEL_LINE)})) AS BIGINT) AS with_labels FROM chat""")
def _(spark, sf):
    return audit.rows_with_form_labels(_chat(spark, sf), "text")


# -------------------------------------------------------------------- tokens


@query("token_topk", f"""WITH {DOCS}, t AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]{{4,}}'))) AS token FROM docs),
  n AS (SELECT token, count(*) AS n FROM t WHERE token NOT IN {in_list(K.TOKEN_STOP_WORDS)} GROUP BY 1),
  w AS (SELECT DISTINCT task_id, unnest(regexp_extract_all(lower(text), {lit(K.WORD + '+')})) AS token FROM docs),
  d AS (SELECT token, count(*) AS docs FROM w GROUP BY 1)
  SELECT token, CAST(n AS BIGINT) AS n, CAST(COALESCE(docs, 0) AS BIGINT) AS docs, round(COALESCE(docs, 0) * 100.0 / (SELECT count(*) FROM docs), 6) AS pct
  FROM n LEFT JOIN d USING (token) ORDER BY n DESC, token LIMIT 20""")
def _(spark, sf):
    return features.token_topk(texts(spark, sf), "text").withColumn("pct", F.round("pct", 6))


def grams_sql(stop):
    drop = f"list_filter(w, lambda t: t NOT IN {in_list(stop)})"
    return f"""toks AS (SELECT task_id, {drop} AS w FROM (SELECT task_id, list_transform(regexp_extract_all(text, '[A-Za-z]{{4,}}'), lambda t: lower(t)) AS w FROM docs)),
uni AS (SELECT task_id, unnest(w) AS term FROM toks),
bi AS (SELECT task_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM toks WHERE len(w) >= 2),
grams AS (SELECT * FROM uni UNION ALL SELECT * FROM bi),
long AS (SELECT task_id, term, count(*) AS tf FROM grams GROUP BY 1, 2),
freq AS (SELECT term, count(*) AS df FROM long GROUP BY 1)"""


@query("count_vectors", f"""WITH {DOCS}, {grams_sql(STOP)} SELECT task_id, term, CAST(tf AS BIGINT) AS tf FROM long JOIN freq USING (term)
  WHERE df >= 2 AND df <= (SELECT count(*) FROM docs) * 0.9""")
def _(spark, sf):
    return features.count_vectors(texts(spark, sf), "text", stop=STOP, max_df=0.9)


@query("tfidf_features")
def _(spark, sf):
    out = features.tfidf_features(texts(spark, sf), "text")
    return out.select("task_id", "term", F.round("weight", 6).alias("weight"))


# -------------------------------------------------------------------- trends


def _scored(spark, sf):
    """Events as scored rows: the value over its maximum of 100 is the confidence."""
    events = table(spark, sf, "events")
    return events.select(F.col("event_id").cast("string").alias("task_id"), "ts", F.col("event_type").alias("label"),
                         F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), (F.col("event_id") % 7 - 1).alias("topic_id"))


_SCORED = """scored AS (SELECT CAST(event_id AS VARCHAR) AS task_id, ts, event_type AS label, least(value / 100, 1.0) AS confidence,
  event_id % 7 - 1 AS topic_id FROM events)"""


@query("confidence_buckets", f"""WITH {_SCORED} SELECT CASE WHEN confidence >= 0.9 THEN '0.90-1.00' WHEN confidence >= 0.7 THEN '0.70-0.90' WHEN confidence >= 0.5 THEN '0.50-0.70'
  ELSE '0.00-0.50' END AS bucket, CAST(count(*) AS BIGINT) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM scored), 6) AS pct FROM scored GROUP BY 1""")
def _(spark, sf):
    return trends.confidence_buckets(_scored(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("confidence_histogram", f"""WITH {_SCORED} SELECT CAST(least(floor(confidence * 20), 19) AS BIGINT) AS bin, round(least(floor(confidence * 20), 19) / 20, 4) AS low,
  CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1, 2""")
def _(spark, sf):
    return trends.confidence_histogram(_scored(spark, sf))


@query("confidence_by_topic", f"""WITH {_SCORED} SELECT label, round(avg(confidence), 6) AS mean_conf, round(median(confidence), 6) AS median_conf,
  CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1""")
def _(spark, sf):
    out = trends.confidence_by_topic(_scored(spark, sf), "label")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_conf", "median_conf")})


_DATED = f"{TASKS}, dated AS (SELECT *, strftime(created_on, '%Y-%m') AS month FROM tasks WHERE topic_id <> -1)"


@query("monthly_volume", f"WITH {_DATED} SELECT month, CAST(count(*) AS BIGINT) AS n FROM dated GROUP BY 1")
def _(spark, sf):
    return trends.monthly_volume(tasks(spark, sf), "created_on")


@query("monthly_volume_topk", f"""WITH {_DATED}, top AS (SELECT platform FROM dated GROUP BY 1 ORDER BY count(*) DESC, platform LIMIT 8)
  SELECT month, platform, CAST(count(*) AS BIGINT) AS n FROM dated WHERE platform IN (SELECT platform FROM top) GROUP BY 1, 2""")
def _(spark, sf):
    return trends.monthly_volume_topk(tasks(spark, sf), "created_on", "platform")


@query("latest_month_breakdown", f"WITH {_DATED} SELECT month, platform, CAST(count(*) AS BIGINT) AS n FROM dated WHERE month = (SELECT max(month) FROM dated) GROUP BY 1, 2")
def _(spark, sf):
    return trends.latest_month_breakdown(tasks(spark, sf), "created_on", "platform")


@query("low_confidence_queue", f"WITH {_SCORED} SELECT task_id, round(confidence, 6) AS confidence FROM scored WHERE confidence < 0.6")
def _(spark, sf):
    return filters.low_confidence_queue(_scored(spark, sf)).select("task_id", F.round("confidence", 6).alias("confidence"))


@query("stream_volume_batch_twin", "SELECT date_trunc('day', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    out = trends.daily_volume(table(spark, sf, "events"), "ts", "event_type")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("monthly_order_volume", "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return trends.monthly_volume(table(spark, sf, "orders"), "o_orderdate", topic=None)
