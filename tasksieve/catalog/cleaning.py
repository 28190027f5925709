"""Sources, filters, text cleaning, de-duplication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.catalog.base import DOCS, TASKS, VEC, docs, lit, order_key, query, squeeze, strip, sub, texts, vectors
from tasksieve.functions import conditions as C
from tasksieve.functions import text as X
from tasksieve.operators import dedup, filters
from tasksieve.session import shared_folder
from tasksieve.sources import tables as S
from tasksieve.sources.tables import table, tasks

# ------------------------------------------------------------------ sources


def _round_trip(spark, df, fmt, read, **options):
    """Write to a new folder below the shared folder and read it back."""
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    S.write_table(df, path, fmt, **options)
    return read(path)


@query("read_tasks", f"WITH {TASKS} SELECT task_id, name, notes, parent_task, household, assignee, issue_type FROM tasks")
def _(spark, sf):
    cols = ["task_id", "name", "notes", "parent_task", "household", "assignee", "issue_type"]
    return _round_trip(spark, tasks(spark, sf).select(cols), "csv", lambda p: S.read_tasks(spark, p, cols))


@query("normalize_cells", f"WITH {DOCS} SELECT task_id, {strip('text')} AS text, COALESCE(CASE WHEN lang = 'en' THEN NULL ELSE lang END, '') AS lang FROM docs")
def _(spark, sf):
    source = docs(spark, sf).select("task_id", "text", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    return S.normalize_cells(source)


@query("read_entity_dict", """SELECT name, category, CAST(length(name) AS BIGINT) AS len FROM (
  SELECT lower(n_name) AS key, arg_max(n_name, seq) AS name, arg_max(category, seq) AS category FROM (
    SELECT n_name, 'nation' AS category, 1000 + n_nationkey AS seq FROM nation
    UNION ALL SELECT r_name, 'region', 2000 + r_regionkey FROM region
    UNION ALL SELECT upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)), 'country', 3000 + n_nationkey FROM nation WHERE n_regionkey = 1)
  GROUP BY 1)""")
def _(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = (nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("category"), (F.col("n_nationkey") + 1000).alias("seq"))
            .unionByName(region.select(F.col("r_name").alias("name"), F.lit("region").alias("category"), (F.col("r_regionkey") + 2000).alias("seq")))
            .unionByName(nation.filter("n_regionkey = 1").select(
                F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)"))).alias("name"),
                F.lit("country").alias("category"), (F.col("n_nationkey") + 3000).alias("seq"))))
    return S.read_entity_dict(spark, rows).withColumn("len", F.col("len").cast("bigint"))


@query("select_existing", f"WITH {TASKS} SELECT task_id, household, platform FROM tasks")
def _(spark, sf):
    return S.select_existing(tasks(spark, sf), ["task_id", "household", "no_such_column", "platform"])


@query("write_table", f"WITH {VEC} SELECT topic_id, CAST(count(*) AS BIGINT) AS n FROM vec GROUP BY 1")
def _(spark, sf):
    assign = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("topic_id"))
    back = _round_trip(spark, assign, "parquet", spark.read.parquet, partition_by=("topic_id",))
    return back.groupBy(F.col("topic_id").cast("bigint").alias("topic_id")).agg(F.count("*").alias("n"))


@query("vector_store", """SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS ids, CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS vectors,
  CAST((SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS BIGINT) AS missing,
  CAST((SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS BIGINT) AS stale,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) = 0
  AND (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) = 0 AS valid""")
def _(spark, sf):
    return S.vector_store(vectors(spark, sf), docs(spark, sf))


@query("json_map_io", "SELECT n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    named = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    S.table_to_json_map(named, "n_name", "r_name").write.text(path)
    return S.json_map_to_table(spark, path)


@query("write_table_bom", f"WITH {DOCS} SELECT task_id, text, lang FROM docs")
def _(spark, sf):
    cols = ["task_id", "text", "lang"]
    return _round_trip(spark, docs(spark, sf).select(cols), "csv", lambda p: S.read_tasks(spark, p, cols), bom=True)


@query("validate_contract", f"""WITH {TASKS} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT task_id) AS BIGINT) AS distinct_ids,
  CAST(count(*) FILTER (task_id = '') AS BIGINT) AS empty_ids, count(*) = count(DISTINCT task_id) AND count(*) FILTER (task_id = '') = 0 AS ok FROM tasks""")
def _(spark, sf):
    return S.contract_report(S.validate_contract(tasks(spark, sf), required=("notes",)))


@query("contract_report_customers", """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT o_custkey) AS BIGINT) AS distinct_ids,
  CAST(0 AS BIGINT) AS empty_ids, count(*) = count(DISTINCT o_custkey) AS ok FROM orders""")
def _(spark, sf):
    return S.contract_report(table(spark, sf, "orders"), "o_custkey")


# ------------------------------------------------------------------ filters

BOT, SESSION = "rewh", "thatin"
_KEEP = f"parent_task = '' AND NOT contains(lower(name), '{BOT}') AND NOT contains(lower(name), '{SESSION}') AND NOT (name = '' AND notes = '')"


def _rules():
    return filters.task_rules(BOT, SESSION)


@query("filter_chain", f"WITH {TASKS} SELECT task_id, name, platform FROM tasks WHERE {_KEEP}")
def _(spark, sf):
    return filters.filter_chain(tasks(spark, sf), _rules()).select("task_id", "name", "platform")


@query("filter_funnel", f"""WITH {TASKS}, s AS (SELECT CASE WHEN parent_task <> '' THEN 1 WHEN contains(lower(name), '{BOT}') THEN 2
  WHEN contains(lower(name), '{SESSION}') THEN 3 WHEN name = '' AND notes = '' THEN 4 END AS step FROM tasks),
  r(step, rule) AS (VALUES (1, 'sub_task'), (2, 'bot'), (3, 'session'), (4, 'empty'))
  SELECT CAST(r.step AS BIGINT) AS step, r.rule, CAST((SELECT count(*) FROM s WHERE s.step = r.step) AS BIGINT) AS removed,
  CAST((SELECT count(*) FROM s WHERE s.step IS NULL OR s.step > r.step) AS BIGINT) AS remaining FROM r""")
def _(spark, sf):
    return filters.filter_funnel(tasks(spark, sf), _rules())


@query("contains_ci", f"WITH {DOCS} SELECT task_id FROM docs WHERE contains(lower(text), 'that with')")
def _(spark, sf):
    return docs(spark, sf).filter(C.contains_ci(F.col("text"), "That With")).select("task_id")


@query("matches_word_ci", f"WITH {DOCS} SELECT task_id FROM docs WHERE regexp_matches(lower(text), {lit(f'(^|{K.NOT_WORD})rewh({K.NOT_WORD}|$)')})")
def _(spark, sf):
    return docs(spark, sf).filter(C.matches_word_ci(F.col("text"), "Rewh")).select("task_id")


@query("coalesce_empty", f"WITH {TASKS} SELECT task_id, CASE WHEN household <> '' THEN household ELSE assignee END AS owner FROM tasks")
def _(spark, sf):
    return tasks(spark, sf).select("task_id", C.coalesce_empty(F.col("household"), F.col("assignee")).alias("owner"))


@query("build_text", f"""WITH {TASKS} SELECT task_id, {strip("array_to_string(list_filter([household, name, notes], lambda x: x <> ''), '. ')")} AS built FROM tasks""")
def _(spark, sf):
    return tasks(spark, sf).select("task_id", C.build_text([F.col("household"), F.col("name"), F.col("notes")], ". ").alias("built"))


@query("min_length_filter", f"WITH {DOCS} SELECT task_id, text FROM docs WHERE length(text) >= 15")
def _(spark, sf):
    return filters.min_length_filter(docs(spark, sf), "text").select("task_id", "text")


@query("length_bucket", """SELECT CASE WHEN l <= 0 THEN '0' WHEN l <= 50 THEN '1-50' WHEN l <= 150 THEN '51-150' WHEN l <= 300 THEN '151-300'
  WHEN l <= 600 THEN '301-600' WHEN l <= 1200 THEN '601-1200' ELSE '>1200' END AS bucket,
  CASE WHEN l < 80 THEN 'Simple' WHEN l < 300 THEN 'Medium' ELSE 'Complex' END AS complexity, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT length(text) AS l FROM documents) GROUP BY 1, 2""")
def _(spark, sf):
    return docs(spark, sf).groupBy(C.length_bucket(F.col("text")).alias("bucket"), C.complexity_bucket(F.col("text")).alias("complexity")).agg(
        F.count("*").alias("n"))


@query("truncate_text", f"WITH {DOCS} SELECT task_id, substring(text, 1, 120) AS cut, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' ELSE text END AS dotted FROM docs")
def _(spark, sf):
    return docs(spark, sf).select("task_id", X.truncate_text(F.col("text"), 120).alias("cut"), X.truncate_text(F.col("text"), 300, "...").alias("dotted"))



@query("cast_or_default", f"""SELECT task_id, CAST(COALESCE(TRY_CAST(CASE WHEN regexp_full_match(f, '[0-9]+') THEN f END AS INTEGER), -1) AS INTEGER) AS parsed
  FROM (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS task_id, CASE WHEN turn % 2 = 0 THEN CAST(length(text) AS VARCHAR) ELSE role END AS f FROM conversations)""")
def _(spark, sf):
    field = F.when(F.col("turn") % 2 == 0, F.length("text").cast("string")).otherwise(F.col("role"))
    return table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("task_id"), C.cast_or_default(field, "int", -1).alias("parsed"))


@query("parse_date_lenient", f"""WITH {TASKS} SELECT task_id, CASE WHEN CAST(task_id AS BIGINT) % 5 = 0 THEN NULL
  ELSE strftime(created_on, '%Y-%m-%d') END AS day FROM tasks""")
def _(spark, sf):
    raw = F.when(order_key() % 5 == 0, F.lit("not a date")).otherwise(F.col("created_on").cast("string"))
    return tasks(spark, sf).select("task_id", F.date_format(C.parse_date_lenient(raw), "yyyy-MM-dd").alias("day"))


# ------------------------------------------------------------- text cleaning

_UNESCAPED = "replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@query("html_to_text", f"SELECT page_id, {sub(_UNESCAPED, '<[^>]+>', ' ')} AS text FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


def _boiler(expr, patterns=None):
    for pattern, flags in patterns or K.BOILERPLATE:
        expr = sub(expr, pattern, " ", flags)
    return expr


# Markers in the vocabulary of the given texts, in the shape of the default patterns.
_LOCAL = [(r"[-\x{2014}\x{2015}\x{2500}]{3,}\s*\n?nt he thst.*", "is"), (r"token = [^\n]*", "i"), (r"https?://\S+", ""),
          (r"(?:the thand|eauou)[,.\s\n].*", "is"), (r"\[insert [^\]]+\]", "i"), (r"\*{2,}", ""), (r"^\s*-{4,}\s*$", "m")]


@query("strip_boilerplate", f"WITH {DOCS} SELECT task_id, {_boiler('text', _LOCAL)} AS text FROM docs")
def _(spark, sf):
    return texts(spark, sf).select("task_id", X.strip_boilerplate(F.col("text"), _LOCAL).alias("text"))


@query("strip_boilerplate_pages", f"SELECT page_id, {_boiler('html')} AS text FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.strip_boilerplate(F.col("html")).alias("text"))


_LABELS = [r"Eron\.", r"Wh\.", r"And ornd\.?", r"On\.?"]
_NOISE = ["la", "los", "en", "the"]


@query("strip_form_labels", f"WITH {DOCS} SELECT task_id, {sub('text', '^(?:' + '|'.join(_LABELS) + r')\s*$', '', 'im')} AS text FROM docs")
def _(spark, sf):
    return texts(spark, sf).select("task_id", X.strip_form_labels(F.col("text"), _LABELS).alias("text"))


@query("strip_noise_answers", f"WITH {DOCS} SELECT task_id, {sub('text', '^(?:' + '|'.join(_NOISE) + r')\s*$', '', 'im')} AS text FROM docs")
def _(spark, sf):
    return texts(spark, sf).select("task_id", X.strip_noise_answers(F.col("text"), _NOISE).alias("text"))


_RULED = "replace(text, ' | ', '————')"


@query("strip_unicode_rules", f"WITH {DOCS} SELECT task_id, {sub(_RULED, K.RULE_CHARS)} AS text FROM docs")
def _(spark, sf):
    return texts(spark, sf).select("task_id", X.strip_unicode_rules(F.replace("text", F.lit(" | "), F.lit("————"))).alias("text"))


def _collapsed(expr):
    return strip(sub(sub(expr, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


@query("collapse_ws", f"WITH {DOCS} SELECT task_id, {_collapsed(sub('text', r'[|*.]', ' '))} AS squeezed, {strip(sub('text', K.SPACE + '+', ' '))} AS one_line FROM docs")
def _(spark, sf):
    loose = F.regexp_replace("text", "[|*.]", " ")
    return texts(spark, sf).select("task_id", X.collapse_ws(loose).alias("squeezed"), X.collapse_ws(F.col("text"), everything=True).alias("one_line"))


def clean_sql(expr, patterns=None, labels=None, noise=None, markup=True):
    out = _boiler(sub(expr, "<[^>]+>", " ") if markup else expr, patterns)
    out = sub(out, "^(?:" + "|".join(labels or K.FORM_LABELS) + r")\s*$", "", "im")
    out = sub(out, "^(?:" + "|".join(noise or K.NOISE_ANSWERS) + r")\s*$", "", "im")
    return _collapsed(sub(out, K.RULE_CHARS))


@query("clean_notes", f"WITH {TASKS} SELECT task_id, {clean_sql('notes', _LOCAL, _LABELS, _NOISE)} AS notes FROM tasks")
def _(spark, sf):
    return tasks(spark, sf, heavy=True).select("task_id", X.clean_notes(F.col("notes"), _LOCAL, _LABELS, _NOISE).alias("notes"))


# Form notes made from the given texts: label lines around whole texts.
_FORM_SQL = "'How may we assist you?:' || chr(10) || text || chr(10) || 'Please specify.:' || chr(10) || source || ' ' || lang"


@query("extract_field", f"""WITH {DOCS}, lines AS (SELECT task_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i,
    source, lang FROM docs), stops AS (SELECT task_id, min(i) FILTER (i > 1 AND regexp_matches(line, '^[A-Za-z][^:]{{2,80}}[?]?:')) AS stop FROM lines GROUP BY 1)
  SELECT d.task_id, {strip("CASE WHEN stop IS NULL THEN text ELSE array_to_string(string_split(text, chr(10))[1:stop - 1], chr(10)) END")} AS intent,
  source || ' ' || lang AS detail FROM docs d JOIN stops s USING (task_id)""")
def _(spark, sf):
    notes = F.concat(F.lit("How may we assist you?:\n"), "text", F.lit("\nPlease specify.:\n"), "source", F.lit(" "), "lang")
    return texts(spark, sf).withColumn("notes", notes).select(
        "task_id", X.extract_field(F.col("notes"), K.INTENT_LABELS[0]).alias("intent"), X.extract_field(F.col("notes"), K.DETAIL_LABEL).alias("detail"))


@query("lowercase", f"WITH {DOCS} SELECT task_id, lower(text) AS text FROM docs")
def _(spark, sf):
    return docs(spark, sf).select("task_id", X.lowercase(F.col("text")).alias("text"))


@query("normalize_unicode")
def _(spark, sf):
    return texts(spark, sf).select("task_id", X.normalize_unicode(F.col("text")).alias("text"))


_DIGITS = sub("text", "[0-9]{4,}", "[ID] [ID]  [ID]")


@query("collapse_placeholders", f"WITH {DOCS} SELECT task_id, {sub(_DIGITS, r'\[ID\](?:\s+\[ID\])+', '[ID]')} AS text FROM docs")
def _(spark, sf):
    return texts(spark, sf).select("task_id", X.collapse_placeholders(F.regexp_replace("text", "[0-9]{4,}", "[ID] [ID]  [ID]")).alias("text"))


def mask_sql(expr):
    for pattern, ci, placeholder in K.STRUCTURAL_MASKS:
        expr = sub(expr, pattern, f" {placeholder} ", "i" if ci else "")
    return squeeze(expr)


@query("mask_structural", f"WITH {DOCS} SELECT task_id, {mask_sql('text')} AS text FROM docs")
def _(spark, sf):
    return texts(spark, sf).select("task_id", X.mask_structural(F.col("text")).alias("text"))


@query("prepare_for_scoring", f"WITH {DOCS} SELECT task_id, {strip(sub('lower(' + mask_sql('text') + ')', K.SPACE + '+', ' '))} AS masked, {strip(sub('lower(text)', K.SPACE + '+', ' '))} AS plain FROM docs")
def _(spark, sf):
    return texts(spark, sf).select("task_id", X.prepare_for_scoring(F.col("text")).alias("masked"), X.prepare_for_scoring(F.col("text"), mask=False).alias("plain"))


@query("strip_greetings", f"WITH {DOCS} SELECT task_id, {sub('text', '(?:' + '|'.join(K.GREETINGS) + ')', ' ', 'i')} AS text FROM docs")
def _(spark, sf):
    return texts(spark, sf).select("task_id", X.strip_greetings(F.col("text")).alias("text"))


# ------------------------------------------------------------ de-duplication


@query("dup_count", f"WITH {DOCS} SELECT task_id, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS dup_count FROM docs")
def _(spark, sf):
    return dedup.dup_count(docs(spark, sf), "text").select("task_id", "dup_count")


_FIRST = """SELECT task_id, text, lang, source, CAST(n AS BIGINT) AS dup_count FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n,
  row_number() OVER (PARTITION BY text ORDER BY CAST(task_id AS BIGINT)) AS r FROM docs) WHERE r = 1"""


def _first(spark, sf):
    return dedup.dedup_keep_first(docs(spark, sf), "text", order_key())


@query("dedup_keep_first", f"WITH {DOCS} {_FIRST}")
def _(spark, sf):
    return _first(spark, sf)


@query("top_repeated", f"WITH {DOCS}, f AS ({_FIRST}) SELECT task_id, dup_count FROM f ORDER BY dup_count DESC, task_id LIMIT 10")
def _(spark, sf):
    return dedup.top_repeated(_first(spark, sf)).select("task_id", "dup_count")


@query("volume_restore", f"""WITH {DOCS}, f AS ({_FIRST}) SELECT CAST(sum(dup_count) AS BIGINT) AS original_rows, CAST(count(*) AS BIGINT) AS unique_rows,
  CAST(sum(dup_count) - count(*) AS BIGINT) AS removed_rows, CAST(count(*) FILTER (dup_count > 1) AS BIGINT) AS repeated_texts FROM f""")
def _(spark, sf):
    return dedup.volume_restore(_first(spark, sf))
