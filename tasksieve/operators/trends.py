"""Confidence and volume reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasksieve.functions.conditions import confidence_bucket
from tasksieve.operators.topics import group_share
from tasksieve.session import BROADCAST_ROWS, checkpointed


def confidence_buckets(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    return group_share(df.select(confidence_bucket(F.col(confidence)).alias("bucket")), ["bucket"])


def confidence_histogram(df: DataFrame, bins: int = 20, confidence: str = "confidence") -> DataFrame:
    """``(bin, low, n)`` over 0 to 1; the top value belongs to the last bin."""
    index = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("bigint")
    return (df.groupBy(index.alias("bin")).agg(F.count("*").alias("n"))
            .select("bin", F.round(F.col("bin") / bins, 4).alias("low"), "n"))


def group_medians(df: DataFrame, group: str, value: str, bins: int = 1_024, few: int = 10_000) -> DataFrame:
    """``(group, median)``, exact on raw doubles with bounded state (nulls and NaN left out).

    The middle ranks of a group are looked for in value ranges: rows are counted in ``bins`` ranges between
    the group's least and greatest value, and only the range that holds a rank is counted again, until it has
    ``few`` rows or a single value; these rows are ranked.  A round is one scan that ships ``bins`` counts a group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = F.array_distinct(F.array(F.floor((F.col("inside") - 1) / 2), F.floor(F.col("inside") / 2)))
    wanted = checkpointed(sizes.select("g", F.explode(ranks).alias("rank"), F.col("rank").alias("k"), "inside", "low", "high"))

    def ranges(table: DataFrame) -> DataFrame:
        each = table.select(F.col("g").alias("tg"), "low", "high").distinct()
        return F.broadcast(each) if each.count() <= BROADCAST_ROWS else each

    holds = F.col("g").eqNullSafe(F.col("tg")) & F.col("v").between(F.col("low"), F.col("high"))
    while True:
        wide = wanted.filter((F.col("inside") > few) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        place = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
        counted = rows.join(ranges(wide), holds).groupBy("tg", "low", "high", place.alias("bin")).agg(
            F.count("*").alias("n"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = Window.partitionBy("tg", "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counted.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
        narrow = (wide.alias("w").join(ranked.alias("r"), F.col("w.g").eqNullSafe(F.col("r.tg")) & (F.col("w.low") == F.col("r.low")) & (F.col("w.high") == F.col("r.high"))
                                       & (F.col("r.ahead") <= F.col("w.k")) & (F.col("w.k") < F.col("r.ahead") + F.col("r.n")))
                  .select("w.g", "w.rank", (F.col("w.k") - F.col("r.ahead")).alias("k"), F.col("r.n").alias("inside"), F.col("r.from").alias("low"), F.col("r.to").alias("high")))
        wanted = checkpointed(wanted.filter((F.col("inside") <= few) | (F.col("low") == F.col("high"))).unionByName(narrow))
    single = wanted.filter("low = high").select("g", F.col("low").alias("v"))
    rest = wanted.filter("low < high")
    order = Window.partitionBy("tg", "low", "high").orderBy("v")
    near = rows.join(ranges(rest), holds).select("tg", "low", "high", "v", (F.row_number().over(order) - 1).alias("at"))  # ``few`` rows a range
    found = rest.alias("w").join(near.alias("r"), F.col("w.g").eqNullSafe(F.col("r.tg")) & (F.col("w.low") == F.col("r.low")) & (F.col("w.high") == F.col("r.high"))
                                 & (F.col("w.k") == F.col("r.at"))).select("w.g", "r.v")
    return single.unionByName(found).groupBy(F.col("g").alias(group)).agg(F.avg("v").alias("median"))


def confidence_by_topic(df: DataFrame, topic: str, confidence: str = "confidence") -> DataFrame:
    """Mean, median and rows per topic, least confident first; both are exact on raw doubles at any size (``group_medians``)."""
    means = df.groupBy(topic).agg(F.avg(confidence).alias("mean_conf"), F.count("*").alias("n"))
    medians = group_medians(df, topic, confidence).withColumnRenamed(topic, "__topic")
    return (means.join(medians, means[topic].eqNullSafe(medians["__topic"]), "left")
            .select(topic, "mean_conf", F.col("median").alias("median_conf"), "n").orderBy("mean_conf", topic))


def month(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM")


def _dated(df: DataFrame, ts: str, topic: str | None) -> DataFrame:
    kept = df.filter(F.col(ts).isNotNull())
    return kept.filter(F.col(topic) != -1) if topic else kept


def monthly_volume(df: DataFrame, ts: str, topic: str | None = "topic_id") -> DataFrame:
    """Classified, dated rows per month."""
    return _dated(df, ts, topic).groupBy(month(ts).alias("month")).agg(F.count("*").alias("n"))


def monthly_volume_topk(df: DataFrame, ts: str, label: str, k: int = 8, topic: str | None = "topic_id") -> DataFrame:
    """Rows per month for the ``k`` largest labels; the second step works on counts."""
    sized = df.filter(F.col(topic) != -1) if topic else df
    biggest = sized.groupBy(label).agg(F.count("*").alias("c")).orderBy(F.desc("c"), label).limit(k).select(label)
    counts = _dated(df, ts, topic).groupBy(month(ts).alias("month"), label).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(biggest), label, "left_semi").select("month", label, "n")


def latest_month_breakdown(df: DataFrame, ts: str, label: str, topic: str | None = "topic_id") -> DataFrame:
    """Rows per label in the last month, largest first."""
    counts = _dated(df, ts, topic).groupBy(month(ts).alias("month"), label).agg(F.count("*").alias("n"))
    last = counts.agg(F.max("month").alias("m")).scalar()
    return counts.filter(F.col("month") == last).select("month", label, "n").orderBy(F.desc("n"), label)


def daily_volume(df: DataFrame, ts: str, key: str, window: str = "1 day") -> DataFrame:
    """Batch twin of the streaming volume job."""
    return (df.groupBy(F.window(F.col(ts).cast("timestamp"), window).alias("w"), key).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), key, "n"))
