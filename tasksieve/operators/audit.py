"""Leakage and traceability audits, column profiles, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.functions.conditions import contains_ci, length_bucket
from tasksieve.functions.text import let, quote, trim_ws
from tasksieve.session import top_per_group, unfold


def _pct(n: Column, total: Column) -> Column:
    return F.when(total > 0, n * 100 / total).otherwise(0.0)


def _present(words: list[str], guarded: tuple[str, ...]):
    """The words a lower-cased text holds; most texts are ruled out by a plain search."""
    def test(t: Column) -> Column:
        tests = []
        for word in words:
            tail = "(?![a-zA-Z])" if word in guarded else f"(?!{K.WORD})"
            whole = t.contains(word.lower()) & t.rlike(f"(?<!{K.WORD}){quote(word.lower())}{tail}")
            tests.append(F.when(whole, word.lower()))
        return F.array_compact(F.array(*tests))

    return test


def leakage_scan(df: DataFrame, c: str, terms: dict[str, list[str]] | None = None, patterns=None, phrases=None,
                 allow=None, guarded: tuple[str, ...] = (), id_col: str = "task_id") -> DataFrame:
    """``(id, type, value, context)``: one row per finding.

    Patterns report every hit; a dictionary term or phrase is reported once per
    text.  Capitalised word runs count as names unless allowed, or unless the text
    shows that people were masked.
    """
    text, lowered = F.col(c), F.lower(c)
    found = []

    def hits(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    for kind, pattern in K.LEAKAGE_PATTERNS if patterns is None else patterns:
        found.append(hits(kind, F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))))
    for kind, words in (terms or {}).items():
        found.append(hits(kind, let(lowered, _present(words, guarded))))
    allow = K.PERSON_ALLOW_LIST if allow is None else allow
    names = F.regexp_extract_all(text, F.lit(K.PERSON_NAME), F.lit(0))
    masked = text.contains("[EMPLOYEE]") | text.contains("[CLIENT]")
    found.append(F.when(~masked, hits("PERSON_NAME", F.filter(names, lambda n: ~n.isin(list(allow)))))
                 .otherwise(F.array().cast("array<struct<type:string,value:string>>")))
    wanted = [p.lower() for p in (K.LEAKAGE_PHRASES if phrases is None else phrases)]
    found.append(hits("BOILERPLATE", let(lowered, lambda t: F.array_compact(F.array(*[F.when(t.contains(p), p) for p in wanted])))))
    with_context = df.withColumn("context", F.substring(c, 1, 100))
    return unfold(with_context, F.concat(*found), "f", id_col, "context").select(id_col, "f.type", "f.value", "context")


def leakage_summary(issues: DataFrame, total: Column, id_col: str = "task_id") -> DataFrame:
    """Findings and texts per type, and over all types (``ALL``) with the clean rate."""
    per_text = issues.groupBy(id_col, "type").agg(F.count("*").alias("n"))
    per_type = per_text.groupBy("type").agg(F.sum("n").alias("findings"), F.count("*").alias("docs"))
    overall = (per_text.groupBy(id_col).agg(F.sum("n").alias("n"))
               .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.count("*").alias("docs"))
               .select(F.lit("ALL").alias("type"), "findings", "docs"))
    return per_type.unionByName(overall).withColumn("clean_pct", _pct(total - F.col("docs"), total))


def leakage_examples(issues: DataFrame, k: int = 10, id_col: str = "task_id") -> DataFrame:
    """The first ``k`` findings of each type."""
    return top_per_group(issues, ["type"], [F.asc(id_col), F.asc("value")], k).select("type", "rank", id_col, "value", "context")


def bias_check(df: DataFrame, c: str, words: list[str] = (), phrases: list[str] = (), guarded: tuple[str, ...] = ()) -> DataFrame:
    """``(term, docs, pct, status)``: texts that hold each watched word or phrase, in one scan."""
    lowered = F.lower(c)
    tests = []
    for word in words:
        tail = "(?![a-z])" if word in guarded else f"(?!{K.WORD})"
        tests.append((word, lowered.rlike(f"(?<!{K.WORD}){quote(word.lower())}{tail}")))
    tests += [(p, contains_ci(F.col(c), p)) for p in phrases]
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(t).alias(f"t{i}") for i, (_, t) in enumerate(tests)])
    rows = F.array(*[F.struct(F.lit(w).alias("term"), F.col(f"t{i}").alias("docs"), _pct(F.col(f"t{i}"), F.col("n")).alias("pct"),
                              F.when(F.col(f"t{i}") > 0, "LEAK").otherwise("CLEAN").alias("status"))
                     for i, (w, _) in enumerate(tests)])
    return wide.select(F.inline(rows))


def traceability_check(before: DataFrame, after: DataFrame, log: DataFrame | None = None, id_col: str = "task_id") -> DataFrame:
    """``(check, ok, n)``: ids lost, ids added, rows equal, output ids unique, log ids known."""
    sides = [("b", before), ("a", after)] + ([("l", log)] if log is not None else [])
    tagged = None
    for name, side in sides:
        part = side.select(F.col(id_col).cast("string").alias("id"), *[
            F.lit(1 if name == s else 0).cast("bigint").alias(s) for s in ("b", "a", "l")])
        tagged = part if tagged is None else tagged.unionByName(part)
    per_id = tagged.groupBy("id").agg(*[F.sum(s).alias(s) for s in ("b", "a", "l")])
    facts = per_id.agg(
        F.count_if((F.col("b") > 0) & (F.col("a") == 0)).alias("lost"), F.count_if((F.col("a") > 0) & (F.col("b") == 0)).alias("extra"),
        F.coalesce(F.abs(F.sum("b") - F.sum("a")), F.lit(0)).alias("row_difference"),
        F.coalesce(F.sum(F.greatest(F.col("a") - 1, F.lit(0))), F.lit(0)).alias("repeated_ids"),
        F.count_if((F.col("l") > 0) & (F.col("a") == 0)).alias("orphan_log_ids"))
    names = ["lost", "extra", "row_difference", "repeated_ids"] + (["orphan_log_ids"] if log is not None else [])
    return facts.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), (F.col(n) == 0).alias("ok"), F.col(n).alias("n")) for n in names])))


# ------------------------------------------------------------------ profiles


def column_fill_rate(df: DataFrame, cols: list[str]) -> DataFrame:
    """Filled and empty cells per existing column, one scan."""
    cols = [c for c in cols if c in df.columns]
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c) != "").alias(f"c{i}") for i, c in enumerate(cols)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("filled"), (F.col("n") - F.col(f"c{i}")).alias("empty"),
                 _pct(F.col(f"c{i}"), F.col("n")).alias("pct")) for i, c in enumerate(cols)])))


def split_counts(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows per rule; a row may match several."""
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(r).alias(f"r{i}") for i, (_, r) in enumerate(rules)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n"), _pct(F.col(f"r{i}"), F.col("n")).alias("pct"))
        for i, (name, _) in enumerate(rules)])))


def value_distribution(df: DataFrame, c: str, k: int = 30, bar: int = 38) -> DataFrame:
    """Top values with a bar length relative to the biggest, and how many more there are."""
    counts = df.filter(F.col(c) != "").groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    facts = counts.agg(F.max("n").alias("m"), F.count("*").alias("c"))
    biggest, values = facts.select("m").scalar(), facts.select("c").scalar()
    return (counts.orderBy(F.desc("n"), "value").limit(k).select(
        "value", "n", F.greatest(F.lit(1), F.floor(F.col("n") / biggest * bar)).cast("bigint").alias("bar"),
        F.greatest(values - k, F.lit(0)).cast("bigint").alias("more_values")))


def length_distribution(df: DataFrame, c: str) -> DataFrame:
    return df.groupBy(length_bucket(F.col(c)).alias("bucket")).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, c: str) -> DataFrame:
    """Shortest, median, mean and longest of the non-empty texts.

    Works on counts per length, a table as long as the longest text.
    """
    counts = df.select(F.length(c).alias("len")).filter("len > 0").groupBy("len").agg(F.count("*").alias("n"))
    return counts.agg(
        F.min("len").cast("bigint").alias("min_len"), F.expr("percentile(len, 0.5, n)").alias("median_len"),
        (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("mean_len"), F.max("len").cast("bigint").alias("max_len"))


def distinct_non_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, n_distinct)``; values are made distinct per column before they are counted."""
    pairs = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])))
    distinct = pairs.filter("value <> ''").distinct()
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(distinct.groupBy("column").agg(F.count("*").alias("n")), "column", "left")
            .select("column", F.coalesce("n", F.lit(0)).alias("n_distinct")))


def coverage_before_after(df: DataFrame, tag: str, topic: str = "topic_id") -> DataFrame:
    """Share tagged before, classified after, the gain in points, and outliers (one place)."""
    before = F.count_if(trim_ws(F.col(tag)) != "") * 100 / F.count("*")
    after = F.count_if(F.col(topic) != -1) * 100 / F.count("*")
    out = df.agg(F.count("*").alias("docs"), F.round(before, 1).alias("pct_before"), F.round(after, 1).alias("pct_after"),
                 F.round(F.count_if(F.col(topic) == -1) * 100 / F.count("*"), 1).alias("pct_outlier"))
    return out.withColumn("gain_points", F.round(F.col("pct_after") - F.col("pct_before"), 1))


def signal_presence(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with and without text in each column."""
    out = column_fill_rate(df.withColumns({c: trim_ws(F.col(c)) for c in cols}), cols)
    return out.select("column", F.col("filled").alias("with_text"), F.col("empty").alias("without_text"), F.round("pct", 1).alias("pct"))


def discover_form_labels(df: DataFrame, c: str, k: int = 20) -> DataFrame:
    """``(label, n, docs)``: lines that look like form labels; ``docs`` counts texts with the label."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"(?md){K.FORM_LABEL_LINE}"), F.lit(1)), trim_ws)
    both = F.concat(
        F.transform(found, lambda x: F.struct(x.alias("label"), F.lit(1).alias("n"), F.lit(0).alias("docs"))),
        F.transform(F.array_distinct(found), lambda x: F.struct(x.alias("label"), F.lit(0).alias("n"), F.lit(1).alias("docs"))))
    counts = unfold(df, both, "hit").select("hit.*").groupBy("label").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return counts.orderBy(F.desc("n"), "label").limit(k)


def rows_with_form_labels(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count("*").alias("docs"), F.count_if(F.col(c).rlike(f"(?md){K.FORM_LABEL_LINE}")).alias("with_labels"))
