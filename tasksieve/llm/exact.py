"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve.llm.common import keep_rows, raw_bytes, text_digest
from tasksieve.session import checkpointed

BLOCK_BYTES = 4096


def _blocks(text: str, size: int) -> Column:
    """A text's bytes in blocks of a fixed size, the last one shorter; the empty text is one empty block."""
    count = F.greatest(F.ceil(F.octet_length(raw_bytes(text)) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(raw_bytes(text), i * size + 1, F.lit(size)))


def _md5(block: Column) -> Column:
    return F.unhex(F.md5(block))


def _named(rows: DataFrame, order: list[str]) -> DataFrame:
    """Distinct rows with an integer name each: sorted within hash shards and numbered shard by shard.

    The names are written to the shared folder, so that a lost executor can't change them.
    """
    named = rows.distinct().sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())
    return checkpointed(named.drop("block") if "key" in rows.columns else named)


def document_names(docs: DataFrame, text: str, id: str, block: int = BLOCK_BYTES,
                   digest: Callable[[Column], Column] | None = _md5) -> DataFrame:
    """Every row with the name of its whole text: ``row``, ``key`` (the id), ``digest``, ``level``, ``name``.

    Distinct blocks are sorted and named by integers; then the names of adjacent blocks are paired,
    distinct pairs are sorted and named, and so on until one name is left.  Two rows get the same
    (level, name) exactly if their texts are equal: names stand for contents, not for hashes.  The
    digest only carries the block names back to the rows without moving the text a second time; if
    two different blocks had the same digest, the blocks themselves would be used instead.
    """
    carry = digest or (lambda x: x)
    rows = checkpointed(docs.select(
        F.col(f"`{id}`").alias("key"), text_digest(f"`{text}`").alias("digest"), F.transform(_blocks(f"`{text}`", block), carry).alias("keys"))
        .withColumn("row", F.monotonically_increasing_id()))
    contents = docs.select(F.explode(_blocks(f"`{text}`", block)).alias("block")).select(carry(F.col("block")).alias("key"), "block")
    names = _named(contents, ["block"])
    if digest is not None and not names.groupBy("key").count().filter("count > 1").isEmpty():
        return document_names(docs, text, id, block, None)
    pieces = rows.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    current = pieces.join(names, "key").select("row", "n", "pos", "name")
    most = rows.agg(F.max(F.size("keys"))).first()[0] or 0
    done, level = [], 0
    while True:
        done.append(current.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        half = F.shiftright("pos", 1)
        pairs = checkpointed(current.filter("n > 1").groupBy("row", "n", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right")))
        current = (pairs.join(_named(pairs.select("left", "right"), ["left", "right"]), ["left", "right"])
                   .select("row", F.shiftright(F.col("n") + 1, 1).alias("n"), "pos", "name"))
        most, level = (most + 1) // 2, level + 1
    whole = done[0]
    for frame in done[1:]:
        whole = whole.unionByName(frame)
    return rows.select("row", "key", "digest").join(whole, "row")


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", block: int = BLOCK_BYTES,
                digest: Callable[[Column], Column] | None = _md5) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``copies``.

    Texts are equal if their bytes are; null counts as empty.  Of equal texts the row with the
    largest id stays (a null id is smaller than any other; of rows that repeat id and text exactly
    one stays).  ``copies`` is the number of rows with the same id and text.  An empty table gives an
    empty result.  Columns other than id and text are not looked at.
    """
    named = checkpointed(document_names(docs, text, id, block, digest))
    groups = named.groupBy("level", "name").agg(F.max(F.struct("key", "row")).alias("best"), F.count("*").alias("group_size"))
    groups = checkpointed(groups)  # a written table, so that the join below is one whose hot names Spark can split
    repeats = named.groupBy("level", "name", "key").agg(F.count("*").alias("copies")).filter("copies > 1")
    joined = named.join(groups, ["level", "name"])
    joined = joined.join(repeats.select(F.col("level").alias("l"), F.col("name").alias("m"), F.col("key").alias("k"), "copies"),
                         (F.col("level") == F.col("l")) & (F.col("name") == F.col("m")) & F.col("key").eqNullSafe(F.col("k")), "left")
    return joined.select("key", F.col("best.key").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
                         F.col("digest").alias("text_sha256"), F.coalesce("copies", F.lit(1)).alias("copies"))


def drop_exact(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without exact copies: all columns of the rows that stay."""
    chosen = exact_dedup(docs, id, text).filter("kept").select("key", F.col("text_sha256").alias("digest"), "copies")
    return keep_rows(docs, chosen, id, text)
