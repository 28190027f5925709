"""Structured Streaming twins of the cleaning, scoring, de-duplication and volume jobs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasksieve.functions.text import clean_notes, lowercase, mask_structural, prepare_for_scoring
from tasksieve.operators.classify import class_names, decide, ranked_classes
from tasksieve.operators.features import strip_accents


def read_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None,
                name_pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    return reader.load(folder)


def stream_clean_mask(sdf: DataFrame, text: str, out: str = "cleaned_text", **config) -> DataFrame:
    """Stateless: the same expressions as in batch."""
    return sdf.withColumn(out, lowercase(mask_structural(clean_notes(F.col(text), **config))))


def stream_score(sdf: DataFrame, model: PipelineModel, pillars: DataFrame, text: str = "text", id_col: str = "task_id",
                 min_chars: int = 5, alternatives: int = 3, mask: bool = True) -> DataFrame:
    """Score a stream of texts with a TF-IDF model; pillars come from a static table."""

    column = model.stages[0].getInputCol()
    clean = sdf.select(id_col, prepare_for_scoring(F.col(text), mask).alias("__clean"))
    scored = model.transform(clean.withColumn(column, strip_accents(F.lower("__clean"))))
    ranked = scored.withColumn("__ranked", ranked_classes(vector_to_array("probability"), class_names(model)))
    return decide(ranked, "__ranked", pillars, class_names(model), F.length("__clean") < min_chars, alternatives, [id_col])


def stream_dedup(sdf: DataFrame, c: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a text that arrive within the watermark; state is a digest per text."""
    timed = sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.withColumn("text_hash", F.sha2(F.col(c), 256)).dropDuplicatesWithinWatermark(["text_hash"])


def stream_volume(sdf: DataFrame, ts: str, key: str, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Rows per window and key; rows later than the watermark are dropped."""
    timed = sdf.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return (timed.groupBy(F.window(ts, window).alias("w"), key).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), key, "n"))


def run_available(sdf: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Process what is there and stop; the sink is a table in a shared folder."""
    query = (sdf.writeStream.format(fmt).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
