"""Session helpers: sane defaults, checkpoint folder, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
#: Slices of a group whose first rows are found before those of the group.
TOP_SLICES = 32


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tasksieve")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="run-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back.

    Like a reliable checkpoint it survives the loss of executors.  As a Parquet
    table it is also computed only once, read column by column, and has a known
    size, which lets the planner broadcast what turns out small.
    """
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, otherwise: str | None = None) -> DataFrame:
    """Broadcast ``df`` only after counting its rows and bytes; a bigger table is left to a shuffle join (hinted ``otherwise``).

    The table is kept once computed, so counting it does not compute it twice.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = kept.limit(max_rows + 1).agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    if rows <= max_rows and size <= BROADCAST_BYTES:
        return F.broadcast(kept)
    return kept.hint(otherwise) if otherwise else kept


def unfold(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of ``array``.

    The outer explode is followed by a null check because Spark puts a filter
    ``size(array) > 0`` below an inner explode, which computes the array twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def rows_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of literal rows given by the caller (rules, maps, seeds)."""
    return spark.createDataFrame(rows, schema)


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank", slices: int = TOP_SLICES) -> DataFrame:
    """The first ``k`` rows of each group, in two levels.

    ``row_number() <= k`` is planned with a group limit on the map side, so every task ships at most
    ``k`` rows per group, however large the group is.  The tasks' rows of a group meet in ``slices`` slices
    first, each cut to ``k`` again, so the last task of a group reads ``slices`` x ``k`` rows at most,
    whatever the number of tasks before.
    """
    part = "__top_slice"
    dealt = df.withColumn(part, F.pmod(F.spark_partition_id(), F.lit(slices)))
    some = (dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*group, part).orderBy(*order)))
            .filter(F.col(rank) <= k).drop(part, rank))
    first = some.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)
    return first.withColumn(rank, F.col(rank).cast("bigint"))


def join_unique(df: DataFrame, right: DataFrame, key: str, weight: str, hot_keys: int = 1000) -> DataFrame:
    """Left join to a table with unique keys, safe when few keys hold most rows.

    ``weight`` is the column of ``right`` that says how many rows of ``df`` a key
    has.  The ``hot_keys`` heaviest keys (a fixed number) are joined by broadcast,
    so their rows stay where they are; in the shuffle join for all the others the
    rows already served are spread by their content.  ``right`` is kept once
    computed, as it is read for both joins.
    """
    right = right.persist(StorageLevel.MEMORY_AND_DISK)
    added = [c for c in right.columns if c != key]
    heaviest = right.orderBy(F.desc(weight), key).limit(hot_keys)
    hot = heaviest.select(key, F.struct(*added).alias("__hot"))
    warm = (right.join(F.broadcast(heaviest.select(key)), key, "left_anti")
            .select(F.xxhash64(key).alias("__slot"), F.col(key).alias("__key"), F.struct(*added).alias("__warm")))
    served = df.join(F.broadcast(hot), key, "left")
    slot = F.when(F.col("__hot").isNull(), F.xxhash64(key)).otherwise(F.xxhash64(*df.columns))
    wanted = F.when(F.col("__hot").isNull(), F.col(key))
    both = (served.withColumn("__slot", slot).withColumn("__want", wanted).alias("l")
            .join(warm.alias("r"), (F.col("l.__slot") == F.col("r.__slot")) & (F.col("l.__want") == F.col("r.__key")), "left"))
    found = F.coalesce("__hot", "__warm")
    return both.select(*[F.col(f"l.{c}") for c in df.columns], *[found[c].alias(c) for c in added])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Dense numbers from 0 in a given order, without a single-task window.

    Rows are range-sorted; a partition's first number is the size of the
    partitions before it, a table with one row per partition.
    """
    placed = checkpointed(df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    parts = placed.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return (placed.join(F.broadcast(offsets), "__part")
            .select(*df.columns, (F.col("__offset") + F.col("__at") - F.col("__first")).alias(name)))
