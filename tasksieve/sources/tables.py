"""Readers and writers, contract checks, and the task view over the given tables."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasksieve.functions.text import trim_ws


def read_tasks(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV export with every cell a string and every empty cell ``""``.

    The column order is declared, so nothing is inferred; a byte order mark and
    blanks around header names do not matter because the header is skipped.
    """
    schema = T.StructType([T.StructField(c.strip().lstrip("﻿"), T.StringType()) for c in columns])
    frame = (spark.read.schema(schema)
             .option("header", True).option("enforceSchema", True).option("multiLine", True)
             .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    return frame.na.fill("")


def normalize_cells(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null becomes ``""`` and every cell loses outer white space."""
    cols = cols or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: trim_ws(F.coalesce(F.col(c), F.lit(""))) for c in cols})


def _flatten(tree: dict, prefix: str = "") -> list[tuple[str, str]]:
    out = []
    for key, value in tree.items():
        category = f"{prefix}{key}"
        if isinstance(value, dict):
            out += _flatten(value, category + ".")
        else:
            out += [(name, category) for name in value or []]
    return out


def _parsed(spark: SparkSession, path: str) -> dict | list:
    """The content of one YAML or JSON file, a dictionary kept by hand."""
    row = spark.read.text(path, wholetext=True).first()
    text = row["value"] if row else ""
    if PurePosixPath(path).suffix == ".json":
        return json.loads(text)
    import yaml

    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError as error:
        raise ValueError(f"{path} is no YAML") from error


def read_entity_dict(spark: SparkSession, source: str | dict | list | DataFrame,
                     fallback: dict | list | None = None) -> DataFrame:
    """``(name, category, len)`` from YAML, JSON, a nested mapping, rows or a table.

    Names are unique regardless of case.  A name listed under two categories
    belongs to the later one.  An unreadable file gives way to ``fallback``.
    """
    if isinstance(source, DataFrame):
        ordered = source.select("name", "category", F.col("seq"))
    else:
        if isinstance(source, str):
            try:
                source = _parsed(spark, source)
            except (AnalysisException, ValueError):  # no such file, or one that can't be parsed
                if fallback is None:
                    raise
                source = fallback
        pairs = _flatten(source) if isinstance(source, dict) else [tuple(r) for r in source]
        ordered = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(pairs)],
                                        "name string, category string, seq int")
    return (ordered.groupBy(F.lower("name").alias("key"))
            .agg(F.max_by("name", "seq").alias("name"), F.max_by("category", "seq").alias("category"))
            .select("name", "category", F.length("name").alias("len")))


def select_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def _marked_lines(df: DataFrame) -> DataFrame:
    """The rows as CSV lines; each task begins its file with the mark and the column names."""
    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    lines = df.select(F.to_csv(F.struct("*"), {"quoteAll": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false",
                                               "ignoreTrailingWhiteSpace": "false"}).alias("value"))

    def headed(batches):
        for i, pdf in enumerate(pdf for pdf in batches if len(pdf)):
            yield pd.concat([pd.DataFrame({"value": [header]}), pdf]) if i == 0 else pdf

    return lines.mapInPandas(headed, "value string")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (),
                mode: str = "overwrite", bom: bool = False) -> None:
    """Parquet by default; CSV exports quote everything and turn nested cells into JSON.

    With ``bom`` every CSV file starts with the UTF-8 byte order mark that spreadsheets look for.
    """
    if fmt == "csv":
        nested = [f.name for f in df.schema
                  if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
        df = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    if bom:
        if fmt != "csv" or partition_by:
            raise ValueError("a byte order mark goes with plain CSV only")
        _marked_lines(df).write.mode(mode).text(path)
        return
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quoteAll", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def vector_store(vectors: DataFrame, ids: DataFrame, id_col: str = "task_id") -> DataFrame:
    """Is a stored vector table valid for these ids?  Compared by id, both ways."""
    sides = (vectors.select(id_col, F.lit(1).alias("v"), F.lit(0).alias("t"))
             .unionByName(ids.select(id_col, F.lit(0).alias("v"), F.lit(1).alias("t")))
             .groupBy(id_col).agg(F.sum("v").alias("v"), F.sum("t").alias("t")))
    return sides.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("ids"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("vectors"),
        F.count_if((F.col("t") > 0) & (F.col("v") == 0)).alias("missing"),
        F.count_if((F.col("v") > 0) & (F.col("t") == 0)).alias("stale"),
    ).withColumn("valid", (F.col("missing") == 0) & (F.col("stale") == 0))


def json_map_to_table(spark: SparkSession, path: str) -> DataFrame:
    """A flat JSON object file as ``(key, value)`` rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def table_to_json_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row with a JSON object, keys in order.  For maps of labels, not of records."""
    entries = F.array_sort(F.collect_list(F.struct(key, value)))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def model_io(path: str, model: PipelineModel | None = None) -> PipelineModel:
    if model is not None:
        model.write().overwrite().save(path)
    return PipelineModel.load(path)


def contract_report(df: DataFrame, id_col: str = "task_id") -> DataFrame:
    """Rows, distinct ids, empty ids; ids are grouped first so no task holds them all."""
    per_id = df.groupBy(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id")).agg(F.count("*").alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("distinct_ids"),
        F.coalesce(F.sum(F.when(F.col("id") == "", F.col("n"))), F.lit(0)).alias("empty_ids"),
    ).withColumn("ok", (F.col("n_rows") == F.col("distinct_ids")) & (F.col("empty_ids") == 0))


def validate_contract(df: DataFrame, id_col: str = "task_id",
                      required: tuple[str, ...] = ("cleaned_text",)) -> DataFrame:
    """Raise unless the required columns exist and ids are unique and non-empty."""
    missing = [c for c in (id_col, *required) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    report = contract_report(df, id_col).first()
    if not report["ok"]:
        raise ValueError(f"ids not unique or empty: {report.asDict()}")
    return df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Text work is heavy, so a table with fewer splits than cores is spread by key.

    Takes a plain scan, whose splits are known without running anything.  Tables
    with enough splits (any big one) are left as they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def _by_remainder(c: Column, modulus: int, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % modulus + 1).cast("int"))


def tasks(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """The given tables in the shape of a task export (see FIXTURES.md).

    ``heavy`` announces work on the texts, see ``spread``.
    """
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    documents = spread(documents, "doc_id") if heavy else documents
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    topics = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return (documents.join(labels, "doc_id", "left").join(topics, "doc_id", "left")
            .select(
                F.col("doc_id").cast("string").alias("task_id"),
                first.alias("name"),
                F.substring(F.col("text"), F.length(first) + 2, F.length("text")).alias("notes"),
                F.when(F.col("doc_id") % 11 == 5, (F.col("doc_id") - 5).cast("string")).otherwise("")
                .alias("parent_task"),
                _by_remainder(F.col("doc_id"), 4, ["Orre Thatin Holdings", "Inoran Family Office", "n/a", ""])
                .alias("household"),
                F.when(F.col("lang") == "en", "Ada Quill").when(F.col("lang") == "fr", "Benoit Marsh")
                .when(F.col("lang") == "de", "cora.lind@example.com").otherwise("").alias("assignee"),
                F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 360).cast("int")).alias("created_on"),
                F.when(F.col("quality").isNull(), "").when(F.col("quality") == 1, "accepted")
                .otherwise("rejected").alias("issue_type"),
                F.col("source").alias("platform"),
                F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("topic_id"),
            ))
