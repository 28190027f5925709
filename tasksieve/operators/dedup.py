"""Exact de-duplication that keeps one row and the size of its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve.operators.filters import attach_count
from tasksieve.session import checkpointed


def dup_count(df: DataFrame, c: str, name: str = "dup_count") -> DataFrame:
    """Attach to every row how often its text occurs."""
    return attach_count(df, [F.col(c)], name)


def dedup_keep_first(df: DataFrame, c: str, key: Column, name: str = "dup_count", row: str | None = None) -> DataFrame:
    """One row per text, the first by ``key``, with the size of its group.

    Only a digest of the text, the key and the row's number are grouped, in a hash aggregation of fixed width
    (for a numeric key) that combines on the map side.  The first rows are then picked by number, so copies of a hot
    text never meet in one task, no whole row is sorted, and columns nobody asks for are not read.

    ``row`` names a column of a stored table that numbers its rows; without it the table is numbered and stored
    first.  Of rows with equal text and key any is kept.  A null text is a text of its own; a null key comes last.
    """
    columns = [x for x in df.columns if x != row]
    if row is None:
        row = "__row"
        df = checkpointed(df.select(*columns, key.alias("__key"), F.monotonically_increasing_id().alias(row)))
        key = F.col("__key")
    digest = F.coalesce(F.unhex(F.sha2(F.col(c).cast("binary"), 256)), F.lit(b""))
    marked = df.select(digest.alias("__text"), key.alias("__key"), F.col(row).alias("__first"))
    least = F.coalesce(F.min_by("__first", "__key"), F.min("__first"))
    first = marked.groupBy("__text").agg(least.alias("__first"), F.count("*").alias("__n")).select("__first", "__n")
    return df.join(first, df[row] == first["__first"]).select(*[df[x] for x in columns], F.col("__n").alias(name))


def top_repeated(df: DataFrame, k: int = 10, count: str = "dup_count", tie: str = "task_id") -> DataFrame:
    return df.orderBy(F.desc(count), tie).limit(k)


def volume_restore(df: DataFrame, count: str = "dup_count") -> DataFrame:
    """Rows before de-duplication, after it, removed, and texts that repeat."""
    return df.agg(
        F.coalesce(F.sum(count), F.lit(0)).alias("original_rows"), F.count("*").alias("unique_rows"),
        (F.coalesce(F.sum(count), F.lit(0)) - F.count("*")).alias("removed_rows"),
        F.count_if(F.col(count) > 1).alias("repeated_texts"))
