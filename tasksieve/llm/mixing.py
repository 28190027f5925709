"""Mixing sources to target weights: packed blocks, multinomial shards, index permutations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasksieve.llm.common import raw_bytes, text_digest
from tasksieve.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 64
SHARD_SLOTS = 4096


def word_count(text: str) -> Column:
    """Number of words, null counting as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``source_size``, ``target`` from (source, size) rows.

    Sources in code point order (null last) get the weights in turn and share ``share`` times all
    words by weight.  A target stops at ``repeats`` times its source's size; what is left over is
    shared again by weight.  The level at which this ends is found by sorting the sources by how many
    words per weight they can take: all below the level are full, the others get weight x level.
    """
    one = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("w", F.element_at(table, ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("source_size") * repeats
    every = Window.partitionBy(F.lit(0))
    before = Window.orderBy(cap / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(cap / F.col("w"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = (ranked.withColumn("total", F.sum("source_size").over(every) * share)
             .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("w").over(after)))
    # the level holds for the first source that it does not fill
    found = steps.withColumn("level", F.min(F.when(F.col("level") <= cap / F.col("w"), F.struct(cap / F.col("w"), "level"))).over(every)["level"])
    return found.select("source", "source_size", F.least(cap.cast("double"), F.coalesce(F.col("w") * F.col("level"), cap.cast("double"))).alias("target"))


def packed(sizes: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """Rows with the place of their first word in the stream of their source: ``begin``.

    The streams are ordered by id and then digest.  Rows are sorted by range; a partition's streams
    begin after what the partitions before hold of the same source, a small table.
    """
    order = [F.col("source").isNull(), "source", F.col("key").isNull(), "key", "digest"]
    placed = checkpointed(sizes.orderBy(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    running = Window.partitionBy("part", "source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    inner = placed.withColumn("inner", F.coalesce(F.sum("size").over(running), F.lit(0)))
    return (inner.join(offsets, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
            .withColumn("begin", F.col("offset") + F.col("inner")).drop("s", "p", "offset", "inner", "part"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, at ``index``.

    A Feistel network over the next even power of two; values outside are sent on until all fall inside.
    """
    index, size, key = index.astype(np.uint64), size.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2).astype(np.float64) + 1) / 2))).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = index.copy(), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(open_):
            left, right = out[open_] >> half[open_], out[open_] & low[open_]
            for r in range(rounds):
                mixed = (right + key[open_] + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & low[open_])
            out[open_] = (left << half[open_]) | right
            open_ = open_[out[open_] >= size[open_]]
    return out.astype(np.int64)


def drawn(quotas: DataFrame, seed: int = 0, slots: int = SHARD_SLOTS) -> DataFrame:
    """Slots (``shard``, ``source``, ``slot``, ``pass``, ``block``) from quotas (source, blocks, quota).

    Each output shard draws how many of its slots every source gets from a multinomial in the
    proportions of the quotas.  A source's slots are numbered through the shards; what is drawn beyond
    the quota is void, and a last shard is filled with what is missing, so each source gets its quota
    exactly.  A source's slot k takes block perm(k mod blocks) in pass k div blocks.  Draws depend on the
    seed, the shard and the names of the sources only, so reruns agree.
    """
    listed = quotas.orderBy(F.col("source").isNull(), "source").agg(
        F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("none"), "source", "quota"))).alias("all"), F.sum("quota").alias("n"))
    shards = listed.filter("n > 0").select("all", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / slots) - 1)).alias("shard"))

    def draw(frames):
        for frame in frames:
            for entry, shard in zip(frame["all"], frame["shard"]):
                wanted = np.array([e["quota"] for e in entry], np.float64)
                got = np.random.default_rng([seed, int(shard)]).multinomial(slots, wanted / wanted.sum())
                hit = np.flatnonzero(got)
                yield pd.DataFrame({"shard": int(shard), "source": [entry[i]["source"] for i in hit], "got": got[hit]})

    counts = checkpointed(shards.repartition(F.col("shard")).mapInPandas(draw, "shard long, source string, got long"))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("from", F.coalesce(F.sum("got").over(earlier), F.lit(0)))
    named = quotas.select(F.col("source").alias("s"), "blocks", "quota")
    same = F.col("source").eqNullSafe(F.col("s"))
    valid = numbered.join(named, same).select("source", "shard", "from", F.least(F.col("from") + F.col("got"), "quota").alias("to"), "blocks", "quota")
    had = counts.groupBy("source").agg(F.sum("got").alias("had"))
    closing = (quotas.join(had.select(F.col("source").alias("s"), "had"), same, "left")
               .select("source", F.lit(-1).cast("long").alias("shard"), F.coalesce("had", F.lit(0)).alias("from"), F.col("quota").alias("to"), "blocks", "quota"))
    # a long run of one source is laid out in pieces of bounded size
    runs = valid.unionByName(closing).filter("from < to")
    pieces = runs.select("*", F.explode(F.sequence(F.col("from"), F.col("to") - 1, F.lit(slots).cast("long"))).alias("lo"))
    slot = pieces.select("shard", "source", "blocks", F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + slots, "to") - 1)).alias("slot"))

    @F.pandas_udf("long")
    def place(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy().astype(np.int64).view(np.uint64)))

    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull())
    return slot.select("shard", "source", "slot", F.floor(F.col("slot") / F.col("blocks")).alias("pass"),
                       place(F.col("slot") % F.col("blocks"), F.col("blocks"), key).alias("block"))


class Mix:
    """A mix of the rows of a table: ``rows`` (sizes and places), ``targets``, ``slots``."""

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS,
                 weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0):
        """Mixes the words of all rows of ``docs``; a null text is empty, a null source is a source of its own.

        The words of a source form one stream, cut into blocks of ``block`` words; a quota of blocks
        is the target over the mean block.  No block is taken more than ``repeats`` times.  Empty
        texts and empty tables take part with nothing.  Rows that repeat id and text are told apart
        by ``copy`` only where the text itself is asked for.
        """
        self.block = block
        sizes = checkpointed(docs.select(F.col(f"`{id}`").alias("key"), text_digest(f"`{text}`").alias("digest"),
                                         F.col(f"`{source}`").cast("string").alias("source"), word_count(f"`{text}`").alias("size")))
        self.targets = checkpointed(source_targets(sizes, weights, share, repeats))
        self.rows = checkpointed(packed(sizes, block).withColumn("row", F.monotonically_increasing_id()))
        blocks = F.ceil(F.col("source_size") / block)
        self.quotas = checkpointed(self.targets.filter("source_size > 0").select(
            "source", blocks.alias("blocks"), F.round(F.col("target") / F.col("source_size") * blocks).cast("long").alias("quota")))
        self.slots = drawn(self.quotas, seed)

    def spans(self) -> DataFrame:
        """Which words of which row each pass takes: ``row``, ``pass``, ``first``, ``past`` (word numbers within the row).

        Blocks and rows are joined by source and block index; a block that was drawn once a pass is a
        unique row on that side, so that a hot source only has many keys.
        """
        block = self.block
        pieces = self.rows.filter("size > 0").select(
            "row", "source", "begin", "size",
            F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"))
        taken = self.slots.select(F.col("source").alias("s"), F.col("block").alias("b"), "pass")
        joined = pieces.join(taken, (F.col("block") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
        return joined.select("row", "pass", F.greatest(F.col("block") * block - F.col("begin"), F.lit(0)).alias("first"),
                             F.least((F.col("block") + 1) * block - F.col("begin"), "size").alias("past"))

    def taken(self) -> DataFrame:
        """One row per row: ``key``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted)."""
        words = self.spans().groupBy("row").agg(F.sum(F.col("past") - F.col("first")).alias("taken"))
        of = self.targets.select(F.col("source").alias("s"), "source_size", "target")
        return (self.rows.join(words, "row", "left").join(of, F.col("source").eqNullSafe(F.col("s")))
                .select("key", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))

    def blocks(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """The mix itself: ``shard``, ``source``, ``slot``, ``words`` (the block's words joined by a space)."""
        block = self.block
        cut = F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD), F.lit(0))
        texts = docs.select(F.col(f"`{id}`").alias("k"), text_digest(f"`{text}`").alias("d"), cut.alias("w")).dropDuplicates(["k", "d"])
        lower = F.floor(F.col("begin") / block)
        upper = F.floor((F.col("begin") + F.col("size") - 1) / block)
        rows = self.rows.filter("size > 0").join(texts, F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")))
        pieces = rows.select("source", "begin", "size", "w", F.explode(F.sequence(lower, upper)).alias("block"))
        first = F.greatest(F.col("block") * block - F.col("begin"), F.lit(0))
        past = F.least((F.col("block") + 1) * block - F.col("begin"), "size")
        pieces = pieces.select("source", "block", "begin", F.array_join(F.slice("w", (first + 1).cast("int"), (past - first).cast("int")), " ").alias("part"))
        whole = pieces.groupBy("source", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("begin", "part"))),
                                                                              lambda x: x["part"]), " ").alias("words"))
        whole = whole.select(F.col("source").alias("s"), F.col("block").alias("b"), "words")
        return (self.slots.join(whole, (F.col("block") == F.col("b")) & F.col("source").eqNullSafe(F.col("s")))
                .select("shard", "source", "slot", "words"))


def cut_words(raw: str, spans: list[tuple[int, int]]) -> str:
    """The given runs of words (sorted, apart) with the text between their words; runs are joined by a line feed."""
    import re

    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", raw)]
    joined: list[list[int]] = []
    for first, past in spans:
        if joined and joined[-1][1] == first:
            joined[-1][1] = past
        else:
            joined.append([first, past])
    if joined == [[0, len(places)]]:
        return raw
    return "\n".join(raw[places[a][0]: places[b - 1][1]] for a, b in joined)


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars",
                    **options) -> DataFrame:
    """The mix as documents: for every pass a row per row of ``docs`` of which the pass takes words.

    The text is cut to the words taken (the whole text if all are), ``n_chars`` (if there) to its
    length; other columns stay.  A row without words, or of which nothing is taken, is left out.
    """
    mix = Mix(docs, id, text, source, **options)
    runs = mix.spans().groupBy("row", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "past"))).alias("spans"))
    runs = runs.join(mix.rows.select("row", "key", "digest"), "row")
    texts = docs.select(F.col(f"`{id}`").alias("k"), text_digest(f"`{text}`").alias("d"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    same = (F.col("d") == F.col("digest")) & F.col("k").eqNullSafe(F.col("key"))
    repeated = checkpointed(mix.rows.groupBy(F.col("key").alias("rk"), F.col("digest").alias("rd")).agg(F.count("*").alias("n")).filter("n > 1"))
    if not repeated.isEmpty():
        # rows that repeat id and text are numbered like their twins in ``rows``; for all others the number is 1
        match = (F.col("d") == F.col("rd")) & F.col("k").eqNullSafe(F.col("rk"))
        copies = mix.rows.select(F.col("row").alias("r"), F.row_number().over(Window.partitionBy("key", "digest").orderBy("row")).alias("copy"))
        runs = runs.join(copies, F.col("row") == F.col("r"))
        again = texts.join(repeated, match, "left_semi")
        again = again.withColumn("c", F.row_number().over(Window.partitionBy("k", "d").orderBy(F.to_json("doc"))))
        texts = texts.join(repeated, match, "left_anti").withColumn("c", F.lit(1)).unionByName(again)
        same = same & (F.col("c") == F.col("copy"))
    joined = texts.join(runs, same)

    @F.arrow_udf("string")
    def cut(raw: pa.Array, spans: pa.Array) -> pa.Array:
        def some(at: int) -> pa.Array:
            return pa.array([cut_words(r, [(s["first"], s["past"]) for s in x]) for r, x in zip(raw.slice(at, 64).to_pylist(), spans.slice(at, 64).to_pylist())], pa.string())

        return pa.concat_arrays([pa.array([], pa.string()), *(some(at) for at in range(0, len(raw), 64))])

    got = joined.select("doc", cut(F.col(f"doc.`{text}`"), F.col("spans")).alias("cut"))
    return got.select(*[F.col("cut").alias(c) if c == text else F.length("cut").cast(docs.schema[c].dataType).alias(c) if c == n_chars
                        else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
