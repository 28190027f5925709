"""Relabelling: merges, names, pillars, nearest-neighbour redistribution, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve.functions.vectors import unit
from tasksieve.operators.neighbours import nearest
from tasksieve.operators.topics import label_distribution
from tasksieve.session import rows_table, small_side

__all__ = ["apply_topic_merges", "apply_name_map", "rename_labels", "override_pillars", "label_distribution",
           "knn_redistribute", "redistribution_summary", "apply_overrides", "dissolve_label_check", "label_to_pillar"]


def _map(df: DataFrame, mapping: dict | DataFrame, key: str, key_type: str, values: str) -> DataFrame:
    """A lookup table; ``mapping`` is given by the caller or already a table."""
    if isinstance(mapping, DataFrame):
        return small_side(mapping)
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in mapping.items()]
    return small_side(rows_table(df.sparkSession, rows, f"{key} {key_type}, {values}"))


def apply_topic_merges(df: DataFrame, merges: dict[int, list[int]], topic: str = "topic_id") -> DataFrame:
    """Rows of source topics move to the target topic."""
    kind = df.schema[topic].dataType.simpleString()
    sources = {s: t for t, group in merges.items() for s in group}
    lookup = _map(df, sources, "__from", kind, f"__to {kind}")
    joined = df.join(lookup, df[topic] == lookup["__from"], "left")
    return joined.select(*[F.coalesce("__to", topic).alias(topic) if c == topic else F.col(c) for c in df.columns])


def apply_name_map(df: DataFrame, names: dict[int, tuple[str, str]], default: str = "Unknown", topic: str = "topic_id",
                   pillar: str = "business_pillar", label: str = "label") -> DataFrame:
    """Pillar and label by topic."""
    kind = df.schema[topic].dataType.simpleString()
    lookup = _map(df, names, "__t", kind, "__pillar string, __label string")
    joined = df.join(lookup, df[topic] == lookup["__t"], "left")
    return joined.select(*df.columns, F.coalesce("__pillar", F.lit(default)).alias(pillar),
                         F.coalesce("__label", F.lit(default)).alias(label))


def rename_labels(df: DataFrame, names: dict[str, str], label: str = "label") -> DataFrame:
    lookup = _map(df, names, "__from", "string", "__to string")
    joined = df.join(lookup, df[label] == lookup["__from"], "left")
    return joined.select(*[F.coalesce("__to", label).alias(label) if c == label else F.col(c) for c in df.columns])


def rename_hits(df: DataFrame, names: dict[str, str], label: str = "label") -> DataFrame:
    """``(old, new, n)``: rows each rule renames, 0 included."""
    lookup = _map(df, names, "old", "string", "new string")
    counts = df.groupBy(F.col(label).alias("old")).agg(F.count("*").alias("n"))
    return lookup.join(counts, "old", "left").select("old", "new", F.coalesce("n", F.lit(0)).alias("n"))


def override_pillars(df: DataFrame, pillars: dict[str, str], label: str = "label", pillar: str = "business_pillar") -> DataFrame:
    lookup = _map(df, pillars, "__label", "string", "__pillar string")
    joined = df.join(lookup, df[label] == lookup["__label"], "left")
    return joined.select(*[F.coalesce("__pillar", pillar).alias(pillar) if c == pillar else F.col(c) for c in df.columns])


def knn_redistribute(vec: DataFrame, labels: DataFrame, dissolve: str, k: int = 7, min_conf: float = 0.0,
                     docs: DataFrame | None = None, id_col: str = "task_id", label: str = "label",
                     text: str = "cleaned_text", **search) -> DataFrame:
    """``(id, proposed_class, confidence, avg_similarity, flag, knn_votes)`` for every row of the dissolved label.

    The ``k`` most similar rows of other labels vote.  The label with most votes
    wins, of equals the one seen at the best rank.  ``knn_votes`` lists ``(label, votes)`` by
    the same order.  Exact; see ``neighbours``.
    """
    units = vec.select(id_col, unit("embedding").alias("embedding"))
    queries = units.join(labels.filter(F.col(label) == dissolve).select(id_col), id_col, "left_semi")
    pool = units.join(labels.filter(F.col(label) != dissolve).select(id_col, label), id_col)
    votes = nearest(queries, pool, k, id_col, carry=label, **search).groupBy(id_col, label).agg(F.count("*").alias("votes"), F.min("rank").alias("first"), F.avg("sim").alias("sim"))
    ballot = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("m"), "first", F.col(label).alias("label"), "sim"))).alias("b")
    best, share = F.col("b")[0], -F.col("b")[0]["m"] / k
    out = votes.groupBy(id_col).agg(ballot).select(
        id_col, best["label"].alias("proposed_class"), share.alias("confidence"), best["sim"].alias("avg_similarity"),
        F.when(share < min_conf, "REVIEW").otherwise("AUTO").alias("flag"),
        F.transform("b", lambda v: F.struct(v["label"].alias("label"), (-v["m"]).alias("votes"))).alias("knn_votes"))
    if docs is not None:
        out = out.join(docs.select(id_col, F.substring(text, 1, 130).alias("text")), id_col)
    return out


def redistribution_summary(res: DataFrame) -> DataFrame:
    """Rows, mean confidence, mean similarity and rows to review by destination, largest first."""
    return res.groupBy("proposed_class").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_conf"), F.avg("avg_similarity").alias("avg_sim"),
        F.count_if(F.col("flag") == "REVIEW").alias("review")).orderBy(F.desc("n"), "proposed_class")


def apply_overrides(df: DataFrame, res: DataFrame, overrides: dict[str, str] | DataFrame, pillars: DataFrame | None = None,
                    id_col: str = "task_id", label: str = "label", pillar: str = "business_pillar") -> DataFrame:
    """New labels: a manual label beats the vote, the vote beats the old label.

    With ``pillars (label, business_pillar)`` the pillar follows the new label.
    Adds ``overridden``.
    """
    manual = (overrides if isinstance(overrides, DataFrame)
              else rows_table(df.sparkSession, list(overrides.items()), f"{id_col} string, __manual string"))
    manual = manual.toDF(id_col, "__manual")
    votes = res.select(id_col, F.col("proposed_class").alias("__vote"))
    decided = votes.join(small_side(manual), id_col, "left").select(
        id_col, F.coalesce("__manual", "__vote").alias("__new"), F.col("__manual").isNotNull().alias("__over"))
    joined = df.join(decided, id_col, "left")
    out = joined.select(*[F.coalesce("__new", label).alias(label) if c == label else F.col(c) for c in df.columns],
                        F.coalesce("__over", F.lit(False)).alias("overridden"), F.col("__new").isNotNull().alias("__moved"))
    if pillars is not None:
        lookup = small_side(pillars.select(F.col(label).alias("__l"), F.col(pillar).alias("__p")))
        out = out.join(lookup, out[label] == lookup["__l"], "left")
        out = out.withColumn(pillar, F.when(F.col("__moved"), F.coalesce("__p", pillar)).otherwise(F.col(pillar))).drop("__l", "__p")
    return out.drop("__moved")


def override_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and manual decisions per destination of relabelled rows."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.count_if("overridden").alias("overridden"))


def dissolve_label_check(df: DataFrame, old: str, label: str = "label") -> DataFrame:
    left = F.count_if(F.col(label) == old)
    return df.agg(left.alias("remaining"), (left == 0).alias("ok"))


def label_to_pillar(df: DataFrame, key: Column, label: str = "label", pillar: str = "business_pillar") -> DataFrame:
    """``(label, pillar, n_pillars)``: pillar of a label's first row, and how many pillars it has."""
    per_pair = df.groupBy(label, pillar).agg(F.min(key).alias("first"))
    return per_pair.groupBy(label).agg(F.min_by(pillar, "first").alias(pillar), F.count("*").alias("n_pillars"))
