"""What the operators of this subpackage share: reading, row choice, components of a link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasksieve.session import checkpointed, top_per_group
from tasksieve.sources.tables import spread, table

#: Bytes of a table that may be broadcast: checked before each broadcast, the shuffle join is the way beyond it.
BROADCAST_BYTES = 64 << 20


#: Rows of an Arrow batch where whole texts go to Python workers; Spark's own 10,000 are meant for narrow rows.
TEXT_ROWS = 1_000


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Have Spark send at most ``rows`` rows to a Python worker at once; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def read(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A given table, spread over the cores if it has fewer splits than cores."""
    text_batches(spark)
    return spread(table(spark, sf_dir, name), key)


def raw_bytes(text: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def text_digest(text: str) -> Column:
    return F.sha2(raw_bytes(text), 256)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (written already, so that counting is cheap) marked for broadcast if it holds few bytes."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def least_hashed(rows: DataFrame, group: str, hash: str, ties: list[Column], k: int) -> DataFrame:
    """The ``k`` rows of each group with the least hash (a bigint, evenly spread), ties by ``ties``; null groups are left out.

    Groups are counted first, and only rows below a hash that about k + 8 sqrt(k) + 32 rows of the group stay below
    are ranked, so that a group's task reads little more than it gives.  Should so few not be enough (ids
    that repeat share a hash), all rows are ranked; the result is the same.
    """
    counted = checkpointed(rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n")))
    spare = k + 8 * k**0.5 + 32
    share = F.col(hash).cast("double") / F.lit(2.0**64) + 0.5
    likely = (rows.join(broadcast_if_small(counted, 64), F.col(group) == F.col("__group"))
              .filter(share * F.col("__n") <= spare).drop("__group", "__n"))
    picked = checkpointed(top_per_group(likely, [group], [F.asc(hash), *ties], k))
    got = picked.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("got"))
    short = counted.join(got, F.col("__group") == F.col("g"), "left").filter(F.coalesce("got", F.lit(0)) < F.least("__n", F.lit(k)))
    if not short.isEmpty():
        picked = checkpointed(top_per_group(rows.filter(F.col(group).isNotNull()), [group], [F.asc(hash), *ties], k))
    return picked


def keep_rows(docs: DataFrame, chosen: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``chosen`` names by (key, digest), each once.

    ``chosen`` holds ``key`` (the id), ``digest`` (SHA-256 of the text) and ``copies``, the number of
    rows of ``docs`` with this id and text.  Only where rows repeat both, they are grouped, and one of
    them stays.  ``docs`` may have any further columns.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id}`").alias("key"),
                         text_digest(f"`{text}`").alias("digest"))
    named = chosen.select(F.col("key").alias("ck"), F.col("digest").alias("cd"), "copies").distinct()
    found = packed.join(named, F.col("key").eqNullSafe(F.col("ck")) & (F.col("digest") == F.col("cd")))
    single = found.filter("copies = 1").select("doc.*")
    repeated = (found.filter("copies > 1").groupBy("key", "digest")
                .agg(F.max_by("doc", F.to_json("doc")).alias("doc")).select("doc.*"))
    return single.unionByName(repeated)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: ``node``, ``component`` (its smallest node).

    Contraction: each round every node points to the node of least random rank among itself and its
    neighbours, and links are carried over to where their ends point.  The links left shrink by a
    constant factor a round, whatever the shape; pointers are then followed back from the last round.
    A hub's links are only aggregated by minimum and joined, never gathered.  Nodes without a link to
    another node are not in the result.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    live = checkpointed(edges.select(low.alias("a"), high.alias("b")).filter("a <> b").distinct())
    pointers: list[DataFrame] = []
    while not live.isEmpty():
        rank = lambda node, salt=len(pointers): F.xxhash64(F.lit(salt), F.col(node))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("b"))).alias("best"))
        own = F.struct(rank("a").alias("rank"), F.col("a").alias("b"))
        step = checkpointed(best.select(F.col("a").alias("node"), F.least("best", own)["b"].alias("head")))
        pointers.append(step)
        ends = (live.join(step.select(F.col("node").alias("a"), F.col("head").alias("x")), "a")
                .join(step.select(F.col("node").alias("b"), F.col("head").alias("y")), "b"))
        live = checkpointed(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not pointers:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    rooted = pointers[-1]
    for step in reversed(pointers[:-1]):
        after = rooted.select(F.col("node").alias("head"), F.col("head").alias("root"))
        rooted = step.join(after, "head", "left").select("node", F.coalesce("root", "head").alias("head"))
    rooted = checkpointed(rooted)
    smallest = rooted.groupBy("head").agg(F.min("node").alias("component"))
    return rooted.join(smallest, "head").select("node", "component")


def row_tag(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``key``, ``tag``, ``raw`` (bytes) of every row; key and tag name a text.

    The tag is zero if no id repeats, else a hash of the text.
    """
    key = F.col(f"`{id}`")
    repeats = not docs.groupBy(key.alias("key")).count().filter("count > 1").isEmpty()
    tag = F.xxhash64(raw_bytes(f"`{text}`")) if repeats else F.lit(0).cast("bigint")
    return docs.select(key.alias("key"), tag.alias("tag"), raw_bytes(f"`{text}`").alias("raw"))
