"""Ordered drop rules and their funnel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve.functions.conditions import contains_ci
from tasksieve.functions.text import trim_ws
from tasksieve.session import join_unique

Rule = tuple[str, Column]


def task_rules(bot_marker: str, session_marker: str, name: str = "name", notes: str = "notes",
               parent: str = "parent_task") -> list[Rule]:
    """The usual drop rules of a task export, in order."""
    return [
        ("sub_task", F.col(parent) != ""),
        ("bot", contains_ci(F.col(name), bot_marker)),
        ("session", contains_ci(F.col(name), session_marker)),
        ("empty", (F.col(name) == "") & (F.col(notes) == "")),
    ]


def filter_chain(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Keep the rows no rule drops (one native predicate, pushed down where possible)."""
    return df.filter(reduce(Column.__and__, [~rule for _, rule in rules]))


def filter_funnel(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows removed and remaining per rule, in one scan.

    Each row counts for the first rule that drops it.
    """
    first = F.coalesce(*[F.when(rule, F.lit(i)) for i, (_, rule) in enumerate(rules, 1)])
    counts = df.select(first.alias("step")).groupBy("step").agg(F.count("*").alias("n"))
    # One row now; its rules are unfolded again.
    wide = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("step") == i, F.col("n"))), F.lit(0)).alias(f"s{i}")
          for i in range(1, len(rules) + 1)])
    steps = []
    removed = F.lit(0).cast("bigint")
    for i, (name, _) in enumerate(rules, 1):
        removed = removed + F.col(f"s{i}")
        steps.append(F.struct(F.lit(i).cast("bigint").alias("step"), F.lit(name).alias("rule"),
                              F.col(f"s{i}").alias("removed"), (F.col("total") - removed).alias("remaining")))
    return wide.select(F.inline(F.array(*steps)))


def min_length_filter(df: DataFrame, c: str, n: int = 15) -> DataFrame:
    return df.filter(F.length(c) >= n)


def training_filter(df: DataFrame, text: str = "cleaned_text", label: str = "label",
                    topic: str = "topic_id") -> DataFrame:
    """Drop outliers, empty texts and empty labels."""
    return df.filter((F.col(topic) != -1) & (trim_ws(F.col(text)) != "") & (trim_ws(F.col(label)) != ""))


def low_confidence_queue(df: DataFrame, confidence: str = "confidence", threshold: float = 0.60) -> DataFrame:
    return df.filter(F.col(confidence) < threshold)


def attach_count(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Attach the size of its group to each row without gathering any group.

    Sizes are counted with map-side combine and joined back by a digest of the
    key; only groups of two and more take part.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys]), 256)
    keyed = df.withColumn("__digest", digest)
    sizes = keyed.groupBy("__digest").agg(F.count("*").alias(name)).filter(F.col(name) > 1)
    joined = join_unique(keyed, sizes, "__digest", name)
    return joined.withColumn(name, F.coalesce(name, F.lit(1))).drop("__digest")
