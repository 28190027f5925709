"""SimHash near-duplicates: fingerprints, pigeonring filtering, Hamming check, components."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasksieve.llm.common import components, keep_rows, raw_bytes, text_digest
from tasksieve.session import checkpointed

SHINGLE_WORDS = 3
MAX_BITS = 2
#: A bucket with more fingerprints is linked through one-bit neighbours instead of pairs; the links are the same.
PAIRED = 64


def _word_runs(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, about ``size`` bytes of text at a time."""
    start, blank = 0, re.compile(rb"[\x20\x09-\x0d]")
    while start < len(raw):
        cut = blank.search(raw, start + size) if start + size < len(raw) else None
        end = cut.start() if cut else len(raw)
        yield raw[start:end].lower().split()
        start = end


def fingerprint(raw: bytes, shingle: int = SHINGLE_WORDS, seed: int = 42) -> int:
    """The 64-bit SimHash of a text given in UTF-8; zero if it has no word.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at space and \\x09-\\x0d only.
    """
    digest, ones, total, tail = partial(xxhash.xxh64_intdigest, seed=seed), np.zeros(64, np.int64), 0, []
    for run in _word_runs(raw):
        words = tail + run
        n = len(words) - shingle + 1
        if n > 0:
            hashes = np.fromiter(map(digest, map(b" ".join, zip(*[words[i:] for i in range(shingle)]))), np.uint64, n)
            ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
        tail = words[-(shingle - 1):] if shingle > 1 else []
    if not total:
        if not tail:
            return 0
        return int(np.uint64(digest(b" ".join(tail))).astype(np.int64))
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id: str, text: str, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``key``, ``digest`` (SHA-256 of the text) and ``fp`` of every row."""
    def run(batches):
        for batch in batches:
            fps = [fingerprint(raw.as_py(), shingle) for raw in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["key", "digest", "fp"])

    rows = docs.select(F.col(f"`{id}`").alias("key"), text_digest(f"`{text}`").alias("digest"), raw_bytes(f"`{text}`").alias("raw"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, digest string, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def segment_masks(parts: int) -> list[int]:
    """64 bits in ``parts`` consecutive segments of nearly equal length."""
    ends = [round(64 * k / parts) for k in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]


def ring_slots(max_bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The slots to look in: (mask whose bits must agree, chain conditions as (mask, budget)).

    The 64 bits form a ring of ``max_bits + 1`` segments.  If two fingerprints differ in at most
    ``max_bits`` bits, then from some segment on, every chain of l consecutive segments has at most
    l * max_bits / segments differences.  That start segment agrees, and the next one has at most one
    difference, so one of its halves agrees: start segment and half are the key of the slot.
    """
    parts = max_bits + 1
    masks = segment_masks(parts)
    slots = []
    for start in range(parts):
        chains, mask = [], 0
        for length in range(1, parts + 1):
            mask |= masks[(start + length - 1) % parts]
            chains.append((mask, length * max_bits // parts))
        if parts == 1:
            slots.append((mask, chains))
            continue
        follower = masks[(start + 1) % parts]
        bits = [k for k in range(64) if follower >> k & 1]
        first = sum(1 << k for k in bits[: len(bits) // 2])
        slots += [(masks[start] | first, chains), (masks[start] | (follower ^ first), chains)]
    return slots


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) whose graph has the components of "differs in at most ``max_bits`` bits" over distinct ``fp``.

    Fingerprints that share a slot's key are candidates.  In buckets of up to ``paired`` fingerprints
    candidates pass the chain conditions, then the full Hamming check.  Bigger buckets (families of
    near copies) would give a square of pairs: there (distance 1 and 2) each fingerprint is sent to
    all points of its one-bit neighbourhood, and those that meet are linked to the least of them,
    which is exact: two words differ in at most two bits exactly if they have a common point.
    """
    slots = ring_slots(max_bits)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("bigint")) for m, _ in slots])).alias("slot", "part"))
    sizes = keyed.groupBy("slot", "part").agg(F.count("*").alias("n")).filter("n > 1")
    busy = checkpointed(keyed.join(sizes, ["slot", "part"]))
    split = max_bits in (1, 2)
    few = busy.filter(F.col("n") <= paired) if split else busy
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    within = F.bit_count(differ) <= max_bits
    for k in range(1, max_bits):
        of_slot = F.element_at(F.array(*[F.lit(_signed(chains[k][0])).cast("bigint") for _, chains in slots]), F.col("x.slot") + 1)
        budget = slots[0][1][k][1]
        within = (F.bit_count(differ.bitwiseAND(of_slot)) <= budget) & within
    near = (few.alias("x").join(few.alias("y"), (F.col("x.slot") == F.col("y.slot")) & (F.col("x.part") == F.col("y.part"))
                                & (F.col("x.fp") < F.col("y.fp")) & within)
            .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    if not split:
        return near.distinct()
    crowd = busy.filter(F.col("n") > paired).select("fp").distinct()
    ones = [F.lit(_signed(1 << k)).cast("bigint") for k in range(64)]
    if max_bits == 2:
        points = F.array(F.struct(F.lit(-1).alias("bit"), F.col("fp").alias("point")),
                         *[F.struct(F.lit(-1).alias("bit"), F.col("fp").bitwiseXOR(one).alias("point")) for one in ones])
    else:
        points = F.array(*[F.struct(F.lit(k).alias("bit"), F.col("fp").bitwiseOR(one).alias("point")) for k, one in enumerate(ones)])
    met = checkpointed(crowd.select("fp", F.explode(points).alias("p")).select("fp", "p.bit", "p.point"))
    least = met.groupBy("bit", "point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    stars = met.join(least, ["bit", "point"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(stars).distinct()


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``digest``, ``fp``, ``component`` (smallest id reachable), ``kept``, ``copies``.

    A null text counts as empty; texts without a word have fingerprint zero and link like any other.
    Fingerprints are linked once each, so copies cost nothing.  Of a component the row with the
    smallest id stays, ties by digest; null ids are looked at last.  ``copies`` is the number of rows
    with the same id and text, of which ``kept`` is true for all or none.  An empty table gives an
    empty result.
    """
    rows = checkpointed(fingerprints(docs, id, text, shingle))
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("digest").alias("digest"))
    fps = checkpointed(rows.groupBy("fp").agg(F.min(order).alias("first")))
    linked = components(fingerprint_links(fps.select("fp"), max_bits), "a", "b")
    labelled = fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    labelled = checkpointed(labelled)
    heads = labelled.groupBy("c").agg(F.min("first").alias("head"))
    of_fp = labelled.join(heads, "c").select("fp", "head")
    repeats = rows.groupBy("key", "digest").agg(F.count("*").alias("copies")).filter("copies > 1")
    repeats = repeats.select(F.col("key").alias("rk"), F.col("digest").alias("rd"), "copies")
    out = rows.join(of_fp, "fp")
    out = out.join(repeats, (F.col("digest") == F.col("rd")) & F.col("key").eqNullSafe(F.col("rk")), "left")
    kept = F.col("key").eqNullSafe(F.col("head.key")) & (F.col("digest") == F.col("head.digest"))
    return out.select("key", "digest", "fp", F.col("head.key").alias("component"), kept.alias("kept"),
                      F.coalesce("copies", F.lit(1)).alias("copies"))


def drop_near(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near copies, all its columns."""
    return keep_rows(docs, simhash_groups(docs, id, text, shingle, max_bits).filter("kept"), id, text)
