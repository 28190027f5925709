"""Substring duplicates by content-defined chunks: gear rolling hash, digests, first owners."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasksieve.llm.common import BROADCAST_BYTES, raw_bytes, row_tag
from tasksieve.session import checkpointed

#: A cut follows a byte where the leading CUT_BITS bits of the hash of the last 32 bytes are zero.
CUT_BITS = 4
LEAST_BYTES = 16
MOST_BYTES = 512
#: Repeated chunks that touch are removed if they have so many bytes together.
RUN_BYTES = 64
GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_cuts(raw: bytes, bits: int = CUT_BITS, piece: int = 1 << 22) -> Iterator[np.ndarray]:
    """Places where the gear hash allows a cut, piece by piece.

    The rolling sum h = 2 h + gear[byte] in 32 bits depends on the last 32 bytes only, so it is
    built by doubling: the hash of 2 m bytes from two hashes of m bytes.
    """
    for start in range(0, len(raw), piece):
        lead = min(start, 31)
        h = GEAR[np.frombuffer(raw, np.uint8, min(piece, len(raw) - start) + lead, start - lead)]
        for m in (1, 2, 4, 8, 16):
            h[m:] += h[:-m].copy() << np.uint32(m)
        at = np.flatnonzero(h >> np.uint32(32 - bits) == 0)
        yield at[at >= lead] + (start - lead + 1)


def chunk_ends(raw: bytes, bits: int = CUT_BITS, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> list[int]:
    """Ends of the chunks of a text; between ``least`` and ``most`` bytes each but for the last."""
    ends, last = [], 0
    for places in gear_cuts(raw, bits):
        for c in places.tolist():
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least:
                ends.append(c)
                last = c
    while len(raw) - last > most:
        last += most
        ends.append(last)
    if last < len(raw):
        ends.append(len(raw))
    return ends


def chunk_digests(raw: bytes, **shape) -> tuple[list[int], list[bytes]]:
    ends = chunk_ends(raw, **shape)
    digest = hashlib.blake2b
    return ends, [digest(raw[a:b], digest_size=16).digest() for a, b in zip([0, *ends], ends)]


def removed_spans(ends: list[int], digests: list[bytes], elsewhere: set[int], run_bytes: int) -> list[tuple[int, int]]:
    """Runs of chunks that repeat, here or in an earlier document (numbers in ``elsewhere``), if long enough."""
    seen, spans = set(), []
    for k, (a, b, d) in enumerate(zip([0, *ends], ends, digests)):
        if d in seen or k in elsewhere:
            if spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        seen.add(d)
    return [(a, b) for a, b in spans if b - a >= run_bytes]


def without(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    """What is left of a text, in order."""
    left, last = [], 0
    for a, b in spans:
        left.append(raw[last:a])
        last = b
    return [*left, raw[last:]]


def chunk_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES, texts: bool = False, **shape) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_bytes``, ``n_chunks``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept`` bytes).

    Texts are bytes in UTF-8, null counts as empty.  A chunk that a document with a smaller id has
    too, or that came before in the same text, is a repeat; touching repeats are removed if they
    have ``run_bytes`` bytes together.  Rows that repeat an id don't count as earlier for each other;
    null ids come last.  Other columns are not looked at; an empty table gives an empty result.

    Only digests are shuffled.  Where each document's repeats are is joined to the texts by broadcast
    if they fit into a fixed number of bytes, else by shuffle.
    """
    rows = row_tag(docs, id, text)

    def cut(batches):
        for batch in batches:
            at, number, first, second = [], [], [], []
            for k, raw in enumerate(batch.column(2)):
                new = {}
                for n, d in enumerate(chunk_digests(raw.as_py(), **shape)[1]):
                    new.setdefault(d, n)
                at += [k] * len(new)
                number += new.values()
                for d in new:
                    a, b = struct.unpack("<qq", d)
                    first.append(a)
                    second.append(b)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                                             names=["key", "tag", "number", "a", "b"])

    kind = rows.schema["key"].dataType.simpleString()
    chunks = rows.mapInArrow(cut, f"key {kind}, tag bigint, number int, a bigint, b bigint")
    owners = chunks.groupBy("a", "b").agg(F.min("key").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    repeats = chunks.join(owners, ["a", "b"]).filter(~F.col("key").eqNullSafe(F.col("owner")))
    hits = checkpointed(repeats.groupBy(F.col("key").alias("hk"), F.col("tag").alias("ht")).agg(F.collect_set("number").alias("numbers")))
    size = hits.agg(F.sum(F.size("numbers") * 4 + 64)).first()[0] or 0
    hits = F.broadcast(hits) if size <= BROADCAST_BYTES else hits
    joined = rows.join(hits, F.col("key").eqNullSafe(F.col("hk")) & (F.col("tag") == F.col("ht")), "left").select("key", "raw", "numbers")

    def drop(batches):
        for batch in batches:
            out = []
            for raw, numbers in zip(batch.column(1), batch.column(2)):
                raw = raw.as_py()
                ends, digests = chunk_digests(raw, **shape)
                spans = removed_spans(ends, digests, set(numbers.as_py() or ()), run_bytes)
                left = b"".join(without(raw, spans))
                out.append((len(raw), len(ends), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if texts else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate([pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts))],
                                             names=["key", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts)

    return joined.mapInArrow(drop, f"key {kind}, n_bytes bigint, n_chunks bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts)
