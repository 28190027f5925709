"""Substring duplicates by a logarithmic family of (sampled) suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasksieve.llm.chunks import without
from tasksieve.llm.common import BROADCAST_BYTES, row_tag
from tasksieve.session import checkpointed

#: Bytes of a match, and of the gram that a sampled suffix starts with.
MATCH_BYTES = 100
GRAM_BYTES = 24
BATCHES = 4
#: Bytes of text handled at once in a worker, few enough for a core's cache.
PIECE = 1 << 16
#: Contexts of one gram compared in one task; more are compared through digests of their strings.
TOGETHER = 20_000
LOW24 = np.uint64((1 << 24) - 1)
BYTE_HASH = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
STEP = 0xD1342543DE82EF95


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every place on, built from powers of two."""
    n, size, part = len(data) - gram + 1, 1, BYTE_HASH[data]
    out, at = None, 0
    while True:
        if gram & size:
            if out is None:
                out = part[:n].copy()
            else:
                out *= np.uint64(pow(STEP, size, 1 << 64))
                out += part[at:at + n]
            at += size
        if 2 * size > gram:
            break
        double = part[:-size] * np.uint64(pow(STEP, size, 1 << 64))
        double += part[size:]
        part, size = double, 2 * size
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


def sampled(texts: list[bytes], length: int = MATCH_BYTES, gram: int = GRAM_BYTES, piece: int = PIECE) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of strings of ``length`` bytes that sample the same suffix: text, start, past, anchor, hash (arrays).

    Of the grams in a string the one of least hash (the first of them) is its anchor; strings that
    are equal have it at the same place.  Strings starting at start..past-1 have the anchor in common,
    so one suffix (from the anchor) stands for all of them: about one in forty is sampled.
    Small texts are handled together, long ones piece by piece.
    """
    group, held = [], 0
    for k, raw in enumerate(texts):
        for start in range(0, max(1, len(raw) - length + 1), piece):
            part = raw[start:start + piece + length - 1]
            if len(part) < length:
                continue
            if held + len(part) > 2 * piece:
                yield _runs(group, length, gram)
                group, held = [], 0
            group.append((k, start, part))
            held += len(part)
    if group:
        yield _runs(group, length, gram)


def _runs(group: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join([part for _, _, part in group]), np.uint8)
    hashes = gram_hashes(data, gram)
    least = hashes & ~LOW24
    least |= np.arange(len(hashes), dtype=np.uint64)
    span, size = length - gram + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[:len(least) - (span - size)], least[span - size:])
    least &= LOW24
    # strings don't cross texts; as an anchor lies in its string, texts have no anchor in common
    ends = np.cumsum([len(part) for _, _, part in group])
    changed = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=changed[1:])
    lasts = ends - length
    changed[lasts[:-1] + length] = True
    first = np.flatnonzero(changed)
    begins = np.r_[0, ends[:-1]]
    owner = np.searchsorted(ends, first, side="right")
    past = np.minimum(np.r_[first[1:], len(least)], lasts[owner] + 1)
    own = first < past
    first, past, owner = first[own], past[own], owner[own]
    anchor = least[first].astype(np.int64)
    shift = np.array([start for _, start, _ in group])[owner] - begins[owner]
    return np.array([k for k, _, _ in group])[owner], first + shift, past + shift, anchor + shift, hashes[anchor].view(np.int64)


def _numbers_of(texts: list[bytes], length: int, gram: int):
    """Runs of all texts as arrays, with the number of the run within its text."""
    parts = list(sampled(texts, length, gram))
    if not parts:
        return [np.zeros(0, np.int64)] * 6
    text, start, past, anchor, hashed = (np.concatenate(x) for x in zip(*parts))
    new = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    number = np.arange(len(text)) - np.repeat(new, np.diff(np.r_[new, len(text)]))
    return text, start, past, anchor, hashed, number


def _kind(rows: DataFrame) -> str:
    return rows.schema["key"].dataType.simpleString()


def repeated_suffixes(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """``key``, ``tag``, ``runs``: a bitmap of the runs of each text whose gram is sampled again elsewhere.

    A gram that is sampled once in the whole corpus can't match, so its suffix need not enter any array.
    """
    def grams(batches):
        for batch in batches:
            text, _, _, _, hashed, number = _numbers_of(batch.column(2).to_pylist(), length, gram)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(hashed, pa.int64()), pa.array(number, pa.int32())],
                                             names=["key", "tag", "gram", "number"])

    found = rows.mapInArrow(grams, f"key {_kind(rows)}, tag bigint, gram bigint, number int")
    # written, so that the join has plain shuffles on both sides and Spark can split common grams
    twice = checkpointed(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    listed = found.join(twice, "gram").groupBy("key", "tag").agg(F.collect_list("number").alias("numbers"))

    def bitmaps(batches):
        for batch in batches:
            maps = []
            for numbers in batch.column(2):
                at = np.asarray(numbers.values)
                bits = np.zeros(at.max() + 1, bool)
                bits[at] = True
                maps.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["key", "tag", "runs"])

    return checkpointed(listed.mapInArrow(bitmaps, f"key {_kind(rows)}, tag bigint, runs binary"))


def with_lists(rows: DataFrame, lists: DataFrame, column: str, item_bytes: int, how: str) -> DataFrame:
    """Rows with their entry of ``lists`` (key, tag, ``column``): by broadcast up to a fixed number of bytes, else by shuffle."""
    items = F.octet_length(column) if lists.schema[column].dataType.simpleString() == "binary" else F.size(column)
    small = (lists.agg(F.sum(items * item_bytes + 64)).first()[0] or 0) <= BROADCAST_BYTES
    named = lists.select(F.col("key").alias("lk"), F.col("tag").alias("lt"), column)
    named = F.broadcast(named) if small else named
    return rows.join(named, F.col("key").eqNullSafe(F.col("lk")) & (F.col("tag") == F.col("lt")), how).select(*rows.columns, column)


def suffix_entries(listed: DataFrame, length: int, gram: int) -> DataFrame:
    """Suffixes to be sorted: ``gram``, ``a``, ``b`` (digest of all bytes of the run), place, and ``again``.

    The context of a run is every byte of its strings.  Within a batch of rows only the first of
    equal contexts goes on under its digest; the others are repeats already (``again``) and are
    scattered, so that a context that a third of all documents share stays a small group.
    """
    def entries(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            text, start, past, anchor, hashed, number = _numbers_of(texts, length, gram)
            maps = batch.column(3).to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(maps), np.uint8), bitorder="little").astype(bool)
            sizes = np.array([8 * len(m) for m in maps])
            begins = np.cumsum(sizes) - sizes
            use = (number < sizes[text]) & bits[np.minimum(begins[text] + number, max(0, len(bits) - 1))] if len(text) else np.zeros(0, bool)
            text, start, past, anchor, hashed = text[use], start[use], past[use], anchor[use], hashed[use]
            raw = b"".join([hashlib.blake2b(texts[k][s:p + length - 1], digest_size=16).digest() for k, s, p in zip(text.tolist(), start.tolist(), past.tolist())])
            digest = np.frombuffer(raw, np.int64).reshape(-1, 2).copy()
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            none = np.array([x is None or x != x for x in keys], bool)
            keys = np.array([0 if x else int(k) for k, x in zip(keys, none)], np.int64)
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            order = np.lexsort((start, tags[text], keys[text], none[text], digest[:, 1], digest[:, 0]))
            ranked = digest[order]
            new = np.ones(len(order), bool)
            new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            again = np.zeros(len(order), bool)
            # rows that repeat id and text are one document
            again[order] = (text[order] != text[head]) & ((keys[text[order]] != keys[text[head]]) | (none[text[order]] != none[text[head]]) | (tags[text[order]] != tags[text[head]])) | (start[order] != start[head])
            digest[again, 0] += start[again] * 2654435761 + text[again]
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed, pa.int64()), pa.array(digest[:, 0], pa.int64()), pa.array(digest[:, 1], pa.int64()), batch.column(0).take(at), batch.column(1).take(at),
                 pa.array(start, pa.int64()), pa.array(past, pa.int64()), pa.array(anchor, pa.int64()), pa.array(again)],
                names=["gram", "a", "b", "key", "tag", "start", "past", "anchor", "again"])

    return listed.mapInArrow(entries, f"gram bigint, a bigint, b bigint, key {_kind(listed)}, tag bigint, start bigint, past bigint, anchor bigint, again boolean")


class SuffixFamily:
    """A logarithmic family of sorted suffix arrays (Bentley and Saxe's method).

    Level r holds the suffixes of 2^r batches, one row for each distinct context with its first place,
    sorted by gram and context within shards.  A new batch becomes an array of its own, is scanned
    together with all levels in that order, and then merges with levels of equal rank, as a binary
    counter carries.  Every suffix is rewritten at most log2(batches) times.
    """

    place = ["key", "tag", "start", "past", "anchor"]

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    def add(self, entries: DataFrame) -> DataFrame:
        """Take in a batch whose ids come after all before; returns its repeats: ``key``, ``tag``, ``start``, ``past``."""
        rows = entries.withColumn("new", F.lit(True))
        for level in self.levels.values():
            rows = rows.unionByName(level.withColumn("again", F.lit(False)).withColumn("new", F.lit(False)))
        order = [F.col("key").isNull(), "key", "tag", "start"]
        first = F.first_value(F.struct("key", "tag", "start")).over(Window.partitionBy("gram", "a", "b").orderBy("new", *order))
        scanned = checkpointed(rows.withColumn("first", first).filter("new").withColumn("repeat", F.col("again") | (
            ~F.col("first.key").eqNullSafe(F.col("key")) | (F.col("first.tag") != F.col("tag")) | (F.col("first.start") != F.col("start")))))
        fresh = scanned.filter("not repeat").select("gram", "a", "b", *self.place)
        rank = 0
        while rank in self.levels:
            fresh = fresh.unionByName(self.levels.pop(rank))
            rank += 1
        self.levels[rank] = checkpointed(fresh.repartition("gram").sortWithinPartitions("gram", "a", "b"))
        return scanned.filter("repeat").select("key", "tag", "start", "past")

    def suffixes(self) -> DataFrame:
        """All distinct contexts with their first places."""
        every = list(self.levels.values())
        out = every[0]
        for level in every[1:]:
            out = out.unionByName(level)
        return out


def context_rows(rows: DataFrame, suffixes: DataFrame, length: int, gram: int) -> DataFrame:
    """Suffixes with the bytes of their contexts, read from the texts of ``rows``.

    Places are packed in one integer: start, number of strings, bytes before the anchor, ``hot``.
    """
    packed = (F.shiftleft("start", 31) + F.shiftleft(F.col("past") - F.col("start"), 16)
              + F.shiftleft(F.col("anchor") - F.col("start"), 1) + F.col("hot").cast("bigint"))
    wanted = checkpointed(suffixes.groupBy("key", "tag").agg(F.collect_set(packed).alias("places")))
    listed = with_lists(rows, wanted, "places", 8, "inner")

    def read(batches):
        for batch in batches:
            at, contexts, places = [], [], []
            for k, (raw, packed_places) in enumerate(zip(batch.column(2), batch.column(3))):
                raw = raw.as_py()
                for p in packed_places.as_py():
                    at.append(k)
                    places.append(p)
                    contexts.append(raw[p >> 31:(p >> 31) + (p >> 16 & 0x7FFF) + length - 1])
            at, places = pa.array(at, pa.int64()), np.array(places, np.int64)
            start, before = places >> 31, places >> 1 & 0x7FFF
            grams = np.frombuffer(b"".join([c[b:b + gram] for c, b in zip(contexts, before.tolist())]), np.uint8)
            hashes = gram_hashes(grams, gram)[::gram].view(np.int64) if len(places) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes), pa.array(start), pa.array(start + (places >> 16 & 0x7FFF)), pa.array(start + before),
                 pa.array((places & 1).astype(bool)), pa.array(contexts, pa.binary())], names=["key", "tag", "gram", "start", "past", "anchor", "hot", "context"])

    return listed.mapInArrow(read, f"key {_kind(rows)}, tag bigint, gram bigint, start bigint, past bigint, anchor bigint, hot boolean, context binary")


def _spans(hit: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Bytes covered by the strings that start where ``hit`` is set."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    return [(int(start + a), int(start + b + length)) for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]])]


def _matched(group: np.ndarray, rows: list[dict], length: int, gram: int) -> list[np.ndarray]:
    """For each context, which of its strings an earlier context of the same gram has (rows are in order of place)."""
    reach = length - gram  # bytes that a string can have before the anchor
    table = np.zeros((len(rows), reach + length + 4), np.uint8)
    table[:, -4:] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    before = np.array([r["anchor"] - r["start"] for r in rows])
    count = np.array([r["past"] - r["start"] for r in rows])
    for k, r in enumerate(rows):
        table[k, reach - before[k]: reach - before[k] + len(r["context"])] = np.frombuffer(r["context"], np.uint8)
    hits = [np.zeros(n, bool) for n in count]
    for back in range(reach + 1):
        use = np.flatnonzero((back <= before) & (back > before - count))
        if len(use) < 2:
            continue
        strings = np.ascontiguousarray(np.c_[table[use, -4:], table[use, reach - back: reach - back + length]]).view(f"V{length + 4}").ravel()
        order, same = _sorted(strings)
        for i in use[order[1:][same]]:
            hits[i][before[i] - back] = True
    return hits


def _sorted(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of byte strings of one size, and which of them equal the one before."""
    _, rank = np.unique(strings, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    return order, rank[order][1:] == rank[order][:-1]


def partial_matches(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Strings that contexts share though they differ as a whole: ``key``, ``tag``, ``spans``.

    Contexts of a gram are compared in one task, many grams at a time: aligned at the anchor, for each
    distance to it the strings are sorted and equal neighbours found.  Grams with very many contexts
    (``hot``) are compared through digests of their strings by aggregation instead.
    """
    kind = _kind(contexts)

    def flush(held):
        group = np.unique([r["gram"] for r in held], return_inverse=True)[1]
        return [(r["key"], r["tag"], s) for r, hit in zip(held, _matched(group, held, length, gram)) if (s := _spans(hit, r["start"], length))]

    def out_of(found):
        spans = [[{"from": a, "to": b} for a, b in s] for _, _, s in found]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                                           pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], names=["key", "tag", "spans"])

    def compare(batches):
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if len(held) >= TOGETHER // 4 and row["gram"] != held[-1]["gram"]:
                    yield out_of(flush(held))
                    held = []
                if not held or any(row[c] != held[-1][c] for c in ("gram", "key", "tag", "start")):  # rows may repeat id and text
                    held.append(row)
        if held:
            yield out_of(flush(held))

    def strings(batches):
        for batch in batches:
            at, digests, starts = [], [], []
            for k, (context, start, past, g, anchor) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("context", "start", "past", "gram", "anchor")))):
                for i in range(past - start):
                    at.append(k)
                    digests.append(hashlib.blake2b(context[i:i + length], digest_size=16).digest())
                    starts.append(start + i)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("tag").take(at), pa.array(digests, pa.binary()), pa.array(starts, pa.int64())],
                                             names=["key", "tag", "digest", "start"])

    order = [F.col("key").isNull().alias("none"), "key", "tag", "start"]
    cold = contexts.filter("not hot").repartition("gram").sortWithinPartitions("gram", *[c if isinstance(c, str) else F.col("key").isNull() for c in order])
    near = cold.mapInArrow(compare, f"key {kind}, tag bigint, spans array<struct<from: bigint, to: bigint>>")
    single = checkpointed(contexts.filter("hot").mapInArrow(strings, f"key {kind}, tag bigint, digest binary, start bigint"))
    firsts = single.groupBy("digest").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = single.join(firsts, "digest").filter(F.struct(*order) != F.col("first"))
    far = later.groupBy("key", "tag").agg(F.collect_list(F.struct(F.col("start").alias("from"), (F.col("start") + length).alias("to"))).alias("spans"))
    return near.unionByName(far)


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def substring_spans(rows: DataFrame, length: int = MATCH_BYTES, gram: int = GRAM_BYTES, batches: int = BATCHES, together: int = TOGETHER) -> DataFrame:
    """``key``, ``tag``, ``spans``: bytes of each text that are covered by a string that also starts earlier."""
    shared = repeated_suffixes(rows, length, gram)
    bounds = shared.agg(F.percentile_approx("key", [k / batches for k in range(1, batches)] or [0.5], 10_000)).first()[0] or []
    edges = sorted(set(bounds)) if batches > 1 else []
    family, found = SuffixFamily(), []
    for low, high in zip([None, *edges], [*edges, None]):
        within = F.lit(True) if low is None else F.col("key") > low
        within = F.coalesce(within & (F.lit(True) if high is None else F.col("key") <= high), F.lit(high is None))
        part = with_lists(rows.filter(within), shared.filter(within), "runs", 1, "inner")
        found.append(family.add(suffix_entries(part, length, gram)))
    whole = found[0]
    for frame in found[1:]:
        whole = whole.unionByName(frame)
    classes = family.suffixes()
    sizes = classes.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1")
    several = classes.join(sizes, "gram").withColumn("hot", F.col("n") > together)
    partial = partial_matches(checkpointed(context_rows(rows, several, length, gram)), length, gram)
    every = whole.select("key", "tag", F.array(F.struct(F.col("start").alias("from"), (F.col("past") + (length - 1)).alias("to"))).alias("spans")).unionByName(partial)
    lists = every.groupBy("key", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def merge(batches):
        for batch in batches:
            spans = [[{"from": a, "to": b} for a, b in merged_spans([(s["from"], s["to"]) for s in x])] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, batch.schema.field(2).type)], names=["key", "tag", "spans"])

    return checkpointed(lists.mapInArrow(merge, f"key {_kind(rows)}, tag bigint, spans array<struct<from: bigint, to: bigint>>"))


def substring_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = MATCH_BYTES, gram: int = GRAM_BYTES,
                    batches: int = BATCHES, together: int = TOGETHER, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (and ``kept`` bytes).

    Texts are bytes in UTF-8, null counts as empty.  A byte is removed if a string of ``length`` bytes
    covers it that also starts earlier: in a text with a smaller id, or earlier in the same text.
    Ids are integers; null ids come last.  Rows that repeat an id are ordered by a hash of their text,
    rows that repeat id and text are one document and get the same result.  Other columns are not
    looked at; an empty table gives an empty result.
    """
    rows = row_tag(docs.withColumn(id, F.col(f"`{id}`").cast("bigint")), id, text)
    spans = substring_spans(rows, length, gram, batches, together)
    joined = with_lists(rows, spans, "spans", 16, "left")

    def drop(batches):
        for batch in batches:
            out = []
            for raw, found in zip(batch.column(2), batch.column(3)):
                raw, found = raw.as_py(), [(s["from"], s["to"]) for s in found.as_py() or ()]
                left = b"".join(without(raw, found))
                out.append((len(raw), len(raw) - len(left), len(found), hashlib.sha256(left).hexdigest(), left if texts else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()] + [pa.binary()] * texts)), batch.column(3)],
                                             names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts + ["spans"])

    return joined.mapInArrow(drop, f"key {_kind(rows)}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts
                             + ", spans array<struct<from: bigint, to: bigint>>")
