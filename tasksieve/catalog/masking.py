"""Name variants, masking, entities, platforms, leakage audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.catalog.base import (DOCS, ENTITIES, PLACEHOLDER, TASKS, TRACKED, docs, in_list, lit, order_key, query, squeeze, strip,
                                    sub, texts)
from tasksieve.catalog.cleaning import clean_sql, mask_sql
from tasksieve.functions.text import mask_structural
from tasksieve.operators import audit, entities, masking
from tasksieve.operators.topics import platform_distribution
from tasksieve.plans.corpus import CorpusConfig, clean_corpus
from tasksieve.sources.tables import table, tasks

CONFIG = CorpusConfig(entities=ENTITIES, tracked=TRACKED, markup=False)


def _names(spark, sf):
    """Names of customers, suppliers, parts, nations and households."""
    def of(frame, column):
        return frame.select(F.col(column).alias("name"))

    return (of(table(spark, sf, "supplier"), "s_name").unionByName(of(table(spark, sf, "customer"), "c_name"))
            .unionByName(of(table(spark, sf, "part"), "p_name")).unionByName(of(table(spark, sf, "nation"), "n_name"))
            .unionByName(of(tasks(spark, sf), "household")).distinct())


_NAMES = f"""{TASKS}, names AS (SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer UNION SELECT p_name FROM part
  UNION SELECT n_name FROM nation UNION SELECT household FROM tasks)"""


def _initials_sql(parts, skip):
    kept = f"list_filter({parts}, lambda w: length(w) > 1 AND lower(w) NOT IN {in_list(skip)})"
    return f"array_to_string(list_transform({kept}, lambda w: upper(substr(w, 1, 1))), '')"


def _core_sql(name, suffix):
    return strip(sub(strip(sub(name, suffix, "", "i")), r"^,+|,+$"))


def _variants_sql(source):
    skip = in_list(K.NAME_SKIP)
    parts = "list_filter(regexp_split_to_array(f, '\\s+'), lambda w: w <> '')"
    return f"""SELECT DISTINCT name, v AS variant FROM (
      SELECT name, unnest([f, CASE WHEN core <> f AND length(core) >= 3 THEN core END,
        CASE WHEN len(w) >= 2 AND length(w[1]) >= 4 THEN w[1] END, CASE WHEN len(w) >= 2 AND length(w[-1]) >= 4 THEN w[-1] END,
        CASE WHEN len(w) >= 2 AND length(w[1] || ' ' || w[2]) >= 5 THEN w[1] || ' ' || w[2] END,
        CASE WHEN len(w) >= 2 AND length(ini) >= 3 THEN ini END]) AS v
      FROM (SELECT name, f, core, w, {_initials_sql('w', K.NAME_SKIP)} AS ini FROM (
        SELECT name, f, {_core_sql('f', K.BUSINESS_SUFFIX)} AS core, {parts} AS w FROM (SELECT name, {strip('name')} AS f FROM {source}))))
      WHERE v IS NOT NULL AND length(v) >= 3 AND lower(v) NOT IN {skip}"""


@query("name_variants", f"WITH {_NAMES} {_variants_sql('names')}")
def _(spark, sf):
    return masking.name_variants(_names(spark, sf))


_WIDE = in_list(K.NAME_SKIP_WIDE)


def _variants_wide_sql(source):
    parts = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
    return f"""SELECT DISTINCT name, v AS variant FROM (
      SELECT name, unnest([f, CASE WHEN core <> f THEN core END, CASE WHEN length(i1) >= 3 THEN i1 END, CASE WHEN length(i2) >= 3 THEN i2 END, plain]) AS v
      FROM (SELECT name, f, core, {_initials_sql(parts.format('f'), K.NAME_SKIP_WIDE)} AS i1, {_initials_sql(parts.format('core'), K.NAME_SKIP_WIDE)} AS i2,
        {strip(sub('f', r'[^\p{L}\p{N}_\s]'))} AS plain FROM (
        SELECT name, f, {_core_sql('f', K.BUSINESS_SUFFIX_WIDE)} AS core FROM (SELECT name, {strip('name')} AS f FROM {source}))))
      WHERE v IS NOT NULL AND length(v) >= 3 AND lower(v) NOT IN {_WIDE} AND NOT regexp_matches(v, '^\\p{{Nd}}+$')"""


@query("name_variants_v2", f"WITH {_NAMES} {_variants_wide_sql('names')}")
def _(spark, sf):
    return masking.name_variants_v2(_names(spark, sf))


_HOUSES = f"""houses AS (SELECT DISTINCT {strip('p')} AS name FROM (SELECT unnest(string_split(household, ',')) AS p FROM tasks)
  WHERE length({strip('p')}) >= 3 AND lower({strip('p')}) NOT IN {in_list(K.HOUSEHOLD_SKIP)}),
staff AS (SELECT DISTINCT assignee AS name FROM tasks WHERE assignee <> '' AND NOT contains(assignee, '@') AND length(assignee) >= 3)"""
_RULES = f"""{_HOUSES}, pairs AS (SELECT variant, '[CLIENT]' AS placeholder, 0 AS s FROM ({_variants_sql('houses')})
  UNION ALL SELECT name, '[EMPLOYEE]', 1 FROM staff
  UNION ALL SELECT split_part(name, ' ', 1), '[EMPLOYEE]', 1 FROM staff WHERE contains(name, ' ') AND length(split_part(name, ' ', 1)) >= 4),
rules AS (SELECT variant, placeholder FROM (SELECT *, row_number() OVER (PARTITION BY lower(variant) ORDER BY length(variant) DESC, s, variant) AS r FROM pairs)
  WHERE r = 1)"""


@query("derive_mask_rules", f"WITH {TASKS}, {_RULES} SELECT variant, placeholder FROM rules")
def _(spark, sf):
    return masking.derive_mask_rules(tasks(spark, sf))


@query("derive_mask_rules_wide", f"""WITH {TASKS}, {_HOUSES}, people AS (SELECT DISTINCT CASE WHEN contains(assignee, '@') THEN
    array_to_string(list_transform(string_split(replace(replace(split_part(assignee, '@', 1), '.', ' '), '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')
    ELSE assignee END AS name FROM tasks WHERE assignee <> ''),
  pairs AS (SELECT variant, '[CLIENT]' AS placeholder, 0 AS s FROM ({_variants_wide_sql('houses')}) WHERE lower(variant) <> 'inoran'
    UNION ALL SELECT variant, '[EMPLOYEE]', 1 FROM ({_variants_wide_sql('people')}))
  SELECT variant, placeholder FROM (SELECT *, row_number() OVER (PARTITION BY lower(variant) ORDER BY length(variant) DESC, s, variant) AS r FROM pairs) WHERE r = 1""")
def _(spark, sf):
    return masking.derive_mask_rules(tasks(spark, sf), generic=["inoran"], wide=True)


# ------------------------------------------------------- dictionary masking

_TERMS = sorted([n for n, _ in ENTITIES], key=lambda t: (-len(t), t))


def _masked_sql(expr):
    """Sequential masking; twice per term, as a match consumes the separators around it."""
    for term in _TERMS:
        placeholder = PLACEHOLDER[dict(ENTITIES)[term]]
        for _ in range(2):
            expr = f"regexp_replace({expr}, {lit(f'(?i)(^|{K.NOT_WORD}){term}({K.NOT_WORD}|$)')}, {lit(rf'\1 {placeholder} \2')}, 'g')"
    return squeeze(expr)


def _entity_rules(spark, sf):
    """The dictionary, kept to the terms that occur (every one does)."""
    rows = [(n, PLACEHOLDER[c]) for n, c in ENTITIES]
    return spark.createDataFrame(rows, "variant string, placeholder string")


@query("mask_dictionary", f"WITH {DOCS} SELECT task_id, {_masked_sql('text')} AS text FROM docs")
def _(spark, sf):
    return masking.mask_dictionary(texts(spark, sf).select("task_id", "text"), "text", _entity_rules(spark, sf), strategy="regex")


@query("mask_dictionary_join", f"WITH {DOCS} SELECT task_id, {_masked_sql('text')} AS text FROM docs")
def _(spark, sf):
    return masking.mask_dictionary(texts(spark, sf).select("task_id", "text"), "text", _entity_rules(spark, sf), strategy="join")


_NESTED = [("the, anea", "[PAIR]"), ("anea", "[WORD]"), ("of, ly", "[PAIR]"), ("ly", "[WORD]")]


def _nested_sql(expr):
    """Longest first, twice per term, as a match consumes the separators around it; these terms don't overlap but for containing each other."""
    for term, placeholder in _NESTED:
        for _ in range(2):
            expr = f"regexp_replace({expr}, {lit(f'(?i)(^|{K.NOT_WORD}){term}({K.NOT_WORD}|$)')}, {lit(rf'\1 {placeholder} \2')}, 'g')"
    return squeeze(expr)


@query("mask_dictionary_nested", f"WITH {DOCS} SELECT task_id, {_nested_sql('text')} AS text FROM docs")
def _(spark, sf):
    """Terms with punctuation that contain each other, among as many rules as there are orders: a walk down the trie."""
    orders = table(spark, sf, "orders").select(F.concat(F.lit("the, anea #"), F.col("o_orderkey")).alias("variant"), F.lit("[ORDER]").alias("placeholder"))
    nested = spark.createDataFrame(_NESTED, "variant string, placeholder string")
    return masking.mask_dictionary(texts(spark, sf).select("task_id", "text"), "text", nested.unionByName(orders), strategy="join")


# The rules that follow from the distinct metadata of the task view.
_DERIVED = {"[CLIENT]": ["Orre Thatin Holdings", "Inoran Family Office", "Inoran Family", "Orre Thatin", "Holdings", "Inoran", "Office", "Orre", "OTH", "IFO"],
            "[EMPLOYEE]": ["Benoit Marsh", "Ada Quill", "Benoit"]}


def _derived_sql(expr):
    rules = sorted(((t, p) for p, ts in _DERIVED.items() for t in ts), key=lambda r: (-len(r[0]), r[0]))
    for term, placeholder in rules:
        for _ in range(2):
            expr = f"regexp_replace({expr}, {lit(f'(?i)(^|{K.NOT_WORD}){term}({K.NOT_WORD}|$)')}, {lit(rf'\1 {placeholder} \2')}, 'g')"
    return squeeze(expr)


@query("mask_derived_rules", f"WITH {TASKS} SELECT task_id, {_derived_sql('notes')} AS notes FROM tasks")
def _(spark, sf):
    source = tasks(spark, sf, heavy=True)
    return masking.mask_dictionary(source.select("task_id", "notes"), "notes", masking.derive_mask_rules(source))


# ------------------------------------------------------------------ entities


def spans(c="text"):
    return entities.extract_entities(F.col(c), ENTITIES)


_ALT = "|".join(_TERMS)


def _marked(expr):
    """Entities between chr(1) and chr(2); twice, as a match consumes the separators around it."""
    for _ in range(2):
        expr = (f"regexp_replace({expr}, {lit(f'(?i)(^|[^\\p{{L}}\\p{{N}}_\\x{{01}}])({_ALT})([^\\p{{L}}\\p{{N}}_\\x{{02}}]|$)')}, "
                f"'\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')")
    return expr


_CATEGORY = "CASE lower(entity) " + " ".join(f"WHEN {lit(n)} THEN {lit(c)}" for n, c in ENTITIES) + " END"
_SPANS = f"""marked AS (SELECT task_id, text, string_split({_marked('text')}, chr(1)) AS p FROM docs),
parts AS (SELECT task_id, text, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM marked),
spans AS (SELECT task_id, text, split_part(part, chr(2), 1) AS entity, i - 1 AS ord,
  CAST(sum(length(replace(part, chr(2), ''))) OVER (PARTITION BY task_id ORDER BY i) - length(replace(part, chr(2), '')) AS BIGINT) AS b, i FROM parts),
ents AS (SELECT task_id, text, entity, ord, b AS span_start, b + length(entity) AS span_end, {_CATEGORY} AS category FROM spans WHERE i > 1)"""


@query("extract_entities", f"WITH {DOCS}, {_SPANS} SELECT task_id, entity, category, span_start, CAST(span_end AS BIGINT) AS span_end FROM ents")
def _(spark, sf):
    return texts(spark, sf).select("task_id", F.explode(spans()).alias("e")).select(
        "task_id", "e.entity", "e.category", F.col("e.start").cast("bigint").alias("span_start"), F.col("e.end").cast("bigint").alias("span_end"))


@query("extract_entities_join", f"WITH {DOCS}, {_SPANS} SELECT task_id, entity, category, span_start, CAST(span_end AS BIGINT) AS span_end FROM ents")
def _(spark, sf):
    """The way for dictionaries that are too big for one pattern."""
    dictionary = spark.createDataFrame(ENTITIES, "name string, category string")
    found = entities.dictionary_spans(texts(spark, sf), "text", dictionary)
    return found.select("task_id", F.explode("spans").alias("e")).select(
        "task_id", "e.entity", "e.category", F.col("e.start").cast("bigint").alias("span_start"), F.col("e.end").cast("bigint").alias("span_end"))


@query("resolve_overlaps", f"WITH {DOCS}, {_SPANS} SELECT task_id, entity, span_start, CAST(span_end AS BIGINT) AS span_end FROM ents")
def _(spark, sf):
    # Two detectors over the same text: the dictionary, and its single words.
    short = entities.extract_entities(F.col("text"), [("rewh", "x"), ("orre", "x"), ("that with", "x")])
    both = texts(spark, sf).select("task_id", entities.resolve_overlaps(F.concat(short, spans())).alias("s"))
    return both.select("task_id", F.explode("s").alias("e")).select(
        "task_id", "e.entity", F.col("e.start").cast("bigint").alias("span_start"), F.col("e.end").cast("bigint").alias("span_end"))


def _cleanup_sql(expr):
    preps, conj = K.CLEANUP_PREPOSITIONS, "and|or|&"
    expr = sub(expr, r"\s{2,}", " ")
    expr = sub(expr, rf"\s+(?:{preps})\s*$", "", "i")
    expr = sub(expr, rf"^\s*(?:{preps})\s+", "", "i")
    expr = sub(expr, rf"\s+(?:{conj})\s*$", "", "i")
    expr = sub(expr, rf"^\s*(?:{conj})\s+", "", "i")
    expr = sub(expr, r"\s{2,}", " ")
    return strip(sub(sub(expr, r"\s*-\s*-\s*", " - "), r",\s*,", ","))






def _removal_sql():
    """Cut by spans, so that neighbouring entities are handled exactly."""
    return f"""{_SPANS}, cut AS (SELECT m.task_id, any_value(m.text) AS text, any_value(len(m.p)) AS n,
  string_agg(CASE WHEN i = 1 THEN part ELSE substr(part, instr(part, chr(2)) + 1) END, '' ORDER BY i) AS rest
  FROM parts JOIN marked m USING (task_id) GROUP BY m.task_id),
cleaned AS (SELECT task_id, text, CASE WHEN n > 1 THEN {_cleanup_sql('rest')} ELSE {strip('text')} END AS cleaned_text FROM cut)"""


@query("remove_entities", f"WITH {DOCS}, {_removal_sql()} SELECT task_id, cleaned_text FROM cleaned")
def _(spark, sf):
    return texts(spark, sf).select("task_id", entities.remove_entities(F.col("text"), spans()).alias("cleaned_text"))


@query("cleanup_orphans", f"WITH {DOCS} SELECT task_id, {_cleanup_sql('text')} AS text FROM docs")
def _(spark, sf):
    return texts(spark, sf).select("task_id", entities.cleanup_orphans(F.col("text")).alias("text"))


_FLAGGED = f"""{_removal_sql()}, near AS (SELECT *, lag(span_end) OVER w AS prev_end, lead(span_start) OVER w AS next_start,
  count(*) OVER (PARTITION BY task_id) AS n FROM ents WINDOW w AS (PARTITION BY task_id ORDER BY ord)),
flagged AS (SELECT e.task_id, e.entity, e.category, e.ord, e.span_start, e.span_end, c.cleaned_text,
  array_to_string(list_filter([
    CASE WHEN regexp_matches(substr(e.text, 1, span_start), {lit(rf'(?i)(^|{K.NOT_WORD})(?:{K.FLAG_PREPOSITIONS})\s*$')}) THEN 'trailing_preposition' END,
    CASE WHEN regexp_matches(substr(e.text, greatest(span_start - 4, 1), least(span_start, 5)) || ' ' || substr(e.text, span_end + 1, 5), '[0-9]') THEN 'numeric_adjacent' END,
    CASE WHEN (prev_end IS NOT NULL AND len(regexp_extract_all(substr(e.text, prev_end + 1, span_start - prev_end), '[^\\s]+')) <= 3)
      OR (next_start IS NOT NULL AND len(regexp_extract_all(substr(e.text, span_end + 1, next_start - span_end), '[^\\s]+')) <= 3) THEN 'adjacent_removal' END,
    CASE WHEN length({strip('c.cleaned_text')}) < 10 THEN 'short_result' END], lambda f: f IS NOT NULL), '|') AS flags
  FROM near e JOIN cleaned c USING (task_id))"""


@query("removal_flags", f"WITH {DOCS}, {_FLAGGED} SELECT task_id, ord, entity, flags FROM flagged")
def _(spark, sf):
    base = texts(spark, sf).select("task_id", "text", spans().alias("s"))
    flags = entities.removal_flags(F.col("text"), F.col("s"), entities.remove_entities(F.col("text"), F.col("s")))
    return base.select("task_id", F.posexplode(F.arrays_zip(F.col("s"), flags.alias("f"))).alias("i", "x")).select(
        "task_id", (F.col("i") + 1).cast("bigint").alias("ord"), F.col("x.s.entity").alias("entity"), F.array_join("x.f", "|").alias("flags"))


# Right context: what follows, with the later entities already cut out.
_CONTEXT = f"""{_FLAGGED}, tails AS (SELECT task_id, i - 1 AS ord, string_agg(substr(part, instr(part, chr(2)) + 1), '')
  OVER (PARTITION BY task_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM parts WHERE i > 1)"""


@query("anonymization_log", f"""WITH {DOCS}, {_CONTEXT} SELECT f.task_id, f.entity AS entity_removed, f.category, f.span_start, CAST(f.span_end AS BIGINT) AS span_end,
  substr(d.text, greatest(f.span_start - 9, 1), least(f.span_start, 10)) || f.entity || substr(t.tail, 1, 10) AS context_window, f.flags, f.cleaned_text
  FROM flagged f JOIN docs d USING (task_id) JOIN tails t USING (task_id, ord)""")
def _(spark, sf):
    marked = texts(spark, sf).withColumn("s", spans())
    log = entities.anonymization_log(marked, "text", "s")
    return log.select("task_id", "entity_removed", "category", F.col("span_start").cast("bigint").alias("span_start"),
                      F.col("span_end").cast("bigint").alias("span_end"), "context_window", F.array_join("flags", "|").alias("flags"), "cleaned_text")


_TRACKED_SQL = "CASE lower(entity) " + " ".join(f"WHEN {lit(t.lower())} THEN {lit(t)}" for t in TRACKED) + " END"


@query("assign_platform", f"""WITH {DOCS}, {_SPANS}, t AS (SELECT task_id, {_TRACKED_SQL} AS p, ord FROM ents),
  r AS (SELECT task_id, p, row_number() OVER (PARTITION BY task_id ORDER BY ord) AS k FROM t WHERE p IS NOT NULL)
  SELECT d.task_id, COALESCE(a.p, 'General') AS primary_platform, b.p AS secondary_platform FROM docs d
  LEFT JOIN r a ON a.task_id = d.task_id AND a.k = 1 LEFT JOIN r b ON b.task_id = d.task_id AND b.k = 2""")
def _(spark, sf):
    return texts(spark, sf).select("task_id", entities.assign_platform(spans(), TRACKED).alias("p")).select("task_id", "p.*")


# ------------------------------------------------------------------ detection


@query("pii_scan", f"""WITH {DOCS}, a AS (SELECT task_id, 'EMAIL_ADDRESS' AS entity_type, 1.0 AS score, unnest(regexp_extract_all(text, {lit(K.EMAIL)})) AS text FROM docs
  UNION ALL SELECT task_id, 'PHONE_NUMBER', 0.9, unnest(regexp_extract_all(text, {lit(K.PHONE)})) FROM docs
  UNION ALL SELECT task_id, 'CREDIT_CARD', 1.0, unnest(regexp_extract_all(text, {lit(K.DETECTORS[3][1])})) FROM docs),
  d AS (SELECT *, list_reverse(list_transform(regexp_extract_all(text, '[0-9]'), lambda c: CAST(c AS INTEGER))) AS g FROM a)
  SELECT task_id, entity_type, CAST(score AS DOUBLE) AS score, text FROM d WHERE entity_type <> 'CREDIT_CARD' OR
  list_sum(list_transform(g, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0""")
def _(spark, sf):
    _, log = masking.pii_scan(texts(spark, sf), "text")
    return log.select("task_id", "entity_type", "score", "text")


@query("pii_scan_masked", f"WITH {DOCS} SELECT task_id, {sub(sub('text', K.EMAIL, '[EMAIL]'), K.PHONE, '[PHONE]')} AS text FROM docs")
def _(spark, sf):
    detectors = [d for d in K.DETECTORS if d[0] in ("EMAIL_ADDRESS", "PHONE_NUMBER")]
    masked, _ = masking.pii_scan(texts(spark, sf).select("task_id", "text"), "text", detectors)
    return masked


_PH = ["[EMAIL]", "[PHONE]", "[ID]", "[URL]"]


@query("placeholder_counts", f"WITH {DOCS}, m AS (SELECT {mask_sql('text')} AS text FROM docs) " + " UNION ALL ".join(
    f"SELECT {lit(p)} AS placeholder, CAST(sum((length(text) - length(replace(text, {lit(p)}, ''))) / {len(p)}) AS BIGINT) AS n FROM m" for p in _PH))
def _(spark, sf):
    return masking.placeholder_counts(texts(spark, sf).select(mask_structural(F.col("text")).alias("text")), "text", _PH)


def _top_sql(expr, stop, suffix):
    drop = f"WHERE t NOT IN {in_list(stop)}" if stop else ""
    return f"""(SELECT row_number() OVER (ORDER BY n DESC, t) AS rank, t AS token_{suffix}, CAST(n AS BIGINT) AS n_{suffix} FROM (
      SELECT t, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all({expr}, '[A-Za-z]{{4,}}'))) AS t FROM docs) {drop} GROUP BY 1) ORDER BY n DESC, t LIMIT 10)"""


@query("masking_impact", f"WITH {DOCS} SELECT rank, token_before, n_before, token_after, n_after FROM {_top_sql('text', [], 'before')} FULL JOIN {_top_sql(mask_sql('text'), K.MASKED_STOP_WORDS, 'after')} USING (rank)")
def _(spark, sf):
    both = texts(spark, sf).select("task_id", "text", mask_structural(F.col("text")).alias("masked"))
    return masking.masking_impact(both, "text", "masked")


# -------------------------------------------------------------------- audits

_TERM_SETS = {"PLATFORM": ["rewh", "orre", "that with"], "BANK": ["ononst"], "CUSTODIAN": ["thatin"], "CLIENT": ["inoran"]}
_WATCH = ["ereden", "the of", "token"]


def _leaks(spark, sf):
    return audit.leakage_scan(texts(spark, sf), "text", _TERM_SETS, phrases=_WATCH, allow=["The The"])


def _found(kind, pattern):
    # Letters beyond ASCII become "_", a word character in RE2 too, so that \\b means the same.
    seen = "text" if kind == "EMAIL" else sub("text", r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}\p{M}]", "_")
    return f"SELECT task_id, '{kind}' AS type, unnest(regexp_extract_all({seen}, {lit(pattern)})) AS value, text FROM docs"


_LEAKS = "leaks AS (" + " UNION ALL ".join(
    [_found(k, p) for k, p in K.LEAKAGE_PATTERNS]
    + [f"SELECT task_id, '{k}', '{w}', text FROM docs WHERE regexp_matches(lower(text), {lit(f'(^|{K.NOT_WORD}){w}({K.NOT_WORD}|$)')})"
       for k, ws in _TERM_SETS.items() for w in ws]
    + [f"SELECT * FROM ({_found('PERSON_NAME', K.PERSON_NAME)}) WHERE value <> 'The The'"]
    + [f"SELECT task_id, 'BOILERPLATE', '{p}', text FROM docs WHERE contains(lower(text), '{p}')" for p in _WATCH]) + ")"


@query("leakage_scan", f"WITH {DOCS}, {_LEAKS} SELECT task_id, type, value, substr(text, 1, 100) AS context FROM leaks")
def _(spark, sf):
    return _leaks(spark, sf)


@query("leakage_dictionary_join", f"""WITH {DOCS}, {_LEAKS} SELECT task_id, type, value, substr(text, 1, 100) AS context FROM leaks
  WHERE type IN ({", ".join(lit(k) for k in _TERM_SETS)})""")
def _(spark, sf):
    dictionary = spark.createDataFrame([(w, k) for k, ws in _TERM_SETS.items() for w in ws], "name string, category string")
    return entities.dictionary_leaks(texts(spark, sf), "text", dictionary)


@query("leakage_summary", f"""WITH {DOCS}, {_LEAKS}, t AS (SELECT type, count(*) AS findings, count(DISTINCT task_id) AS docs FROM leaks GROUP BY 1
  UNION ALL SELECT 'ALL', count(*), count(DISTINCT task_id) FROM leaks)
  SELECT type, CAST(findings AS BIGINT) AS findings, CAST(docs AS BIGINT) AS docs, round(((SELECT count(*) FROM documents) - docs) * 100.0 / (SELECT count(*) FROM documents), 6) AS clean_pct FROM t""")
def _(spark, sf):
    total = docs(spark, sf).agg(F.count("*").alias("n")).scalar()
    return audit.leakage_summary(_leaks(spark, sf), total).withColumn("clean_pct", F.round("clean_pct", 6))


@query("leakage_examples", f"""WITH {DOCS}, {_LEAKS} SELECT type, r AS rank, task_id, value FROM (SELECT type, task_id, value,
  row_number() OVER (PARTITION BY type ORDER BY task_id, value) AS r FROM leaks) WHERE r <= 10""")
def _(spark, sf):
    return audit.leakage_examples(_leaks(spark, sf)).select("type", "rank", "task_id", "value")


_BIAS_WORDS, _BIAS_PHRASES = ["rewh", "orre", "nosuchname"], ["please select the priority", "the of"]


@query("bias_check", f"WITH {DOCS} " + " UNION ALL ".join(
    [f"SELECT '{w}' AS term, CAST(count(*) FILTER (regexp_matches(lower(text), {lit(f'(^|{K.NOT_WORD}){w}({K.NOT_WORD}|$)')})) AS BIGINT) AS docs, "
     f"round(count(*) FILTER (regexp_matches(lower(text), {lit(f'(^|{K.NOT_WORD}){w}({K.NOT_WORD}|$)')})) * 100.0 / count(*), 6) AS pct, "
     f"CASE WHEN count(*) FILTER (regexp_matches(lower(text), {lit(f'(^|{K.NOT_WORD}){w}({K.NOT_WORD}|$)')})) > 0 THEN 'LEAK' ELSE 'CLEAN' END AS status FROM docs" for w in _BIAS_WORDS]
    + [f"SELECT '{p}', CAST(count(*) FILTER (contains(lower(text), '{p}')) AS BIGINT), round(count(*) FILTER (contains(lower(text), '{p}')) * 100.0 / count(*), 6), "
       f"CASE WHEN count(*) FILTER (contains(lower(text), '{p}')) > 0 THEN 'LEAK' ELSE 'CLEAN' END FROM docs" for p in _BIAS_PHRASES]))
def _(spark, sf):
    return audit.bias_check(texts(spark, sf), "text", _BIAS_WORDS, _BIAS_PHRASES).withColumn("pct", F.round("pct", 6))


@query("traceability_check", f"""WITH {TASKS}, f AS (SELECT * FROM tasks WHERE parent_task = ''), facts AS (SELECT
  (SELECT count(*) FROM tasks WHERE task_id NOT IN (SELECT task_id FROM f)) AS lost, 0 AS extra,
  (SELECT count(*) FROM tasks) - (SELECT count(*) FROM f) AS diff, (SELECT count(*) FROM tasks WHERE topic_id = -1 AND parent_task <> '') AS orphan)
  SELECT 'lost' AS "check", lost = 0 AS ok, CAST(lost AS BIGINT) AS n FROM facts UNION ALL SELECT 'extra', true, 0 FROM facts
  UNION ALL SELECT 'row_difference', diff = 0, CAST(diff AS BIGINT) FROM facts UNION ALL SELECT 'repeated_ids', true, 0 FROM facts
  UNION ALL SELECT 'orphan_log_ids', orphan = 0, CAST(orphan AS BIGINT) FROM facts""")
def _(spark, sf):
    before = tasks(spark, sf)
    return audit.traceability_check(before, before.filter("parent_task = ''"), before.filter("topic_id = -1"))


# ---------------------------------------------------------------- end to end

_NAME_AND_NOTES = strip(f"array_to_string(list_filter([name, {clean_sql('notes', markup=False)}], lambda x: x <> ''), ' ')")
_CORPUS = f"""{TASKS}, kept AS (SELECT * FROM tasks WHERE parent_task = '' AND NOT contains(lower(name), 'helperbot') AND NOT contains(lower(name), 'working session')
  AND NOT (name = '' AND notes = '')),
built AS MATERIALIZED (SELECT task_id, {_NAME_AND_NOTES} AS original_text FROM kept),
structural AS MATERIALIZED (SELECT task_id, {mask_sql('original_text')} AS t FROM built),
docs AS MATERIALIZED (SELECT task_id, {_derived_sql('t')} AS text FROM structural),
{_removal_sql()}, tp AS (SELECT task_id, {_TRACKED_SQL} AS p, ord FROM ents),
rp AS (SELECT task_id, p, row_number() OVER (PARTITION BY task_id ORDER BY ord) AS k FROM tp WHERE p IS NOT NULL),
full_ AS (SELECT c.task_id, lower(c.cleaned_text) AS cleaned_text, COALESCE(a.p, 'General') AS primary_platform, b.p AS secondary_platform FROM cleaned c
  LEFT JOIN rp a ON a.task_id = c.task_id AND a.k = 1 LEFT JOIN rp b ON b.task_id = c.task_id AND b.k = 2),
corpus AS (SELECT *, row_number() OVER (PARTITION BY cleaned_text ORDER BY CAST(task_id AS BIGINT)) AS r,
  CAST(count(*) OVER (PARTITION BY cleaned_text) AS BIGINT) AS dup_count FROM full_ WHERE length(cleaned_text) >= 15)"""


@query("flagship", f"""WITH {_CORPUS} SELECT primary_platform, CAST(count(*) AS BIGINT) AS n,
  round(count(*) * 100.0 / (SELECT count(*) FROM corpus WHERE r = 1), 6) AS pct FROM corpus WHERE r = 1 GROUP BY 1""")
def _(spark, sf):
    """Raw tasks to clean corpus, then texts per platform."""
    corpus, _, _ = clean_corpus(tasks(spark, sf, heavy=True), CONFIG, order_key())
    shares = platform_distribution(corpus, "primary_platform").withColumn("pct", F.round("pct", 6))
    return shares.orderBy(F.desc("n"), "primary_platform")


@query("clean_corpus", f"WITH {_CORPUS} SELECT task_id, cleaned_text, primary_platform, secondary_platform, dup_count FROM corpus WHERE r = 1")
def _(spark, sf):
    corpus, _, _ = clean_corpus(tasks(spark, sf, heavy=True), CONFIG, order_key())
    return corpus.select("task_id", "cleaned_text", "primary_platform", "secondary_platform", "dup_count")
