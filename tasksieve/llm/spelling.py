"""Spelling variants: near words met in sorted permuterm rotations, and the form each word is a variant of."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasksieve.llm.common import broadcast_if_small
from tasksieve.session import checkpointed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Marks the end of a word in a rotation; no word holds it.
END = "$"
#: Code points of a text searched at once, and words a task counts before it hands them on.
PIECE, HELD_WORDS = 1 << 20, 100_000
#: Rotations of up to so many letters are kept as texts; longer ones as hashes of fixed width, as a word has as many rotations as letters.
TEXT_ROTATION = 64
#: Prime and bases of the hashes, four of 31 bits.
PRIME, BASES = (1 << 31) - 1, (1_000_003, 998_244_353, 754_974_721, 469_762_049)


def runs(text: str):
    """The lower-cased runs of letters, in pieces that no run crosses: a list of words for each piece."""
    start = 0
    while start < len(text):
        end = min(len(text), start + PIECE)
        if end < len(text):
            inside = RUN.match(text, end)
            end = inside.end() if inside else end
        yield RUN.findall(text[start:end].translate(LOWER))
        start = end


def as_written(key: bytes, run: str) -> str:
    """The run, without one code point if 97 divides the CRC-32 of ``<key>:<run>``."""
    check = zlib.crc32(run.encode(), zlib.crc32(key + b":"))
    if check % 97:
        return run
    at = check % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``(word, n)``: words of at least ``min_length`` code points that occur at least ``min_count`` times in all texts.

    Every task adds up the words of its rows and hands its counts on whenever it holds ``HELD_WORDS`` of them.
    """
    def count(batches):
        held: dict[str, int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                name, value = (key.as_py() or "").encode(), value.as_py() or ""
                for words in runs(value):
                    within: dict[str, int] = {}
                    for word in words:
                        within[word] = within.get(word, 0) + 1
                    for word, n in within.items():
                        word = as_written(name, word)
                        if len(word) >= min_length:
                            held[word] = held.get(word, 0) + n
                    if len(held) > HELD_WORDS:
                        yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col(f"`{id}`").cast("string").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    have = 1
    while have < n:
        step = pow(base, have, PRIME)
        out[have:2 * have] = out[:min(have, n - have)] * step % PRIME
        have *= 2
    return out


def _hashed(word: str, gaps: bool) -> list[str]:
    """Names of fixed width for the rotations of a long word: what is ahead of each place, and what is behind it.

    With ``gaps`` the letter at the place is skipped; without, the place lies between two letters.
    """
    code = np.array([ord(c) for c in word], np.int64)
    n = len(code)
    sides = []
    for base in BASES:
        power = _powers(base, n + 1)
        sums = np.concatenate([[0], np.cumsum(code * power[:n] % PRIME) % PRIME])
        at = np.arange(n if gaps else n + 1)
        behind = (sums[n] - sums[at + 1 if gaps else at]) % PRIME
        sides.append((sums[at], behind if gaps else behind * base % PRIME))
    letters = n - 1 if gaps else n
    return [f"{END}{letters}:{k}:" + ":".join(f"{a[k]:x}.{b[k]:x}" for a, b in sides) for k in range(n if gaps else n + 1)]


def rotations(word: str) -> list[tuple[str, str]]:
    """The rotations of a terminator-marked word as (range, skipped letter).

    A rotation that begins behind the letter at place i ends in that letter; without it, it is the range ``behind$ahead``
    that all words share which differ in that letter only.  The word with no letter at the place is the range itself and
    comes first in it (skipped letter ``""``).  Where a letter repeats, one of its places stands for an indel: see ``near_words``.
    """
    n = len(word)
    skipped = [word[k + 1:] + END + word[:k] for k in range(n)] if n - 1 <= TEXT_ROTATION else _hashed(word, True)
    whole = [word[k:] + END + word[:k] for k in range(n + 1)] if n <= TEXT_ROTATION else _hashed(word, False)
    return [*zip(skipped, word), *zip(whole, [""] * (n + 1))]


def rotation_table(words: DataFrame) -> DataFrame:
    """``(range, letter, first, word, n)``: all rotations of all words; ``first`` says that the letter differs from the one ahead of it."""
    def turn(batches):
        for batch in batches:
            names, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(names):
                rows, letters, first, owner, n = [], [], [], [], []
                while at < len(names) and len(rows) < 50_000:
                    word = names[at]
                    for k, (key, letter) in enumerate(rotations(word)):
                        rows.append(key)
                        letters.append(letter)
                        first.append(not letter or k == 0 or word[k - 1] != letter)
                    owner += [word] * (2 * len(word) + 1)
                    n += [counts[at]] * (2 * len(word) + 1)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(letters, pa.string()), pa.array(first, pa.bool_()), pa.array(owner, pa.string()), pa.array(n, pa.int64())],
                                                 names=["range", "letter", "first", "word", "n"])

    return words.select("word", "n").mapInArrow(turn, "range string, letter string, first boolean, word string, n bigint")


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, near, n)``: both ways, each word with its near words and how often these occur, for who wants the links themselves."""
    table = rotation_table(words)
    left = table.select("range", F.col("letter").alias("l"), F.col("first").alias("f"), "word")
    right = table.select("range", F.col("letter").alias("r"), F.col("first").alias("g"), F.col("word").alias("near"), "n")
    apart = (F.col("l") != F.col("r")) & F.when(F.col("l") == "", F.col("g")).when(F.col("r") == "", F.col("f")).otherwise(True)
    return left.join(right, "range").filter(apart).select("word", "near", "n")


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best, best_n)`` of every word that has a near word: their number, and the one that occurs most.

    Rotations are dealt by range and sorted in it, as the sorted list of all rotations has them side by side.  A range
    holds one word for each letter, so a group is no larger than the alphabet; what each of its words has beside itself
    follows from the first two and the number of words, not from pairs.  Words that differ by a replaced letter share one
    range.  Words that differ by a letter more share one range for each place of the letter in a run of equal
    ones (``aab``, ``ab``); only the first of these places counts.
    """
    group = Window.partitionBy("range")
    by_count = group.orderBy(F.desc("n"), "word")
    whole, replaced = F.col("letter") == "", F.col("letter") != ""
    ranked = rotation_table(words).select(
        "*", F.count("*").over(group).alias("members"),
        F.row_number().over(group.orderBy(whole.cast("int"), F.desc("n"), "word")).alias("place")).filter("members > 1")
    entry = F.struct(F.col("n"), F.col("word"))
    scanned = ranked.select(
        "*",
        F.count_if(replaced).over(group).alias("others"),
        F.count_if(replaced & F.col("first")).over(group).alias("longer"),
        F.max(F.when(whole, entry)).over(group).alias("shorter"),
        F.max(F.when(replaced & (F.col("place") == 1), entry)).over(group).alias("one"),
        F.max(F.when(replaced & (F.col("place") == 2), entry)).over(group).alias("two"),
        F.first(F.when(replaced & F.col("first"), entry), ignorenulls=True).over(
            by_count.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("longest"))
    beside = F.when(F.col("place") == 1, F.col("two")).otherwise(F.col("one"))
    indel = F.when(F.col("first"), F.col("shorter"))
    counted = F.when(whole, F.col("longer")).otherwise(F.col("others") - 1 + indel.isNotNull().cast("int"))
    candidates = F.when(whole, F.array("longest")).otherwise(F.array(beside, indel))
    found = scanned.select("word", counted.alias("n_near"), F.array_compact(candidates).alias("near")).filter("n_near > 0")
    best = F.min(F.struct((-F.col("c.n")).alias("minus"), F.col("c.word").alias("word")))
    # a word has at most 2 x length + 1 such rows
    each = found.select("word", "n_near", F.posexplode("near").alias("k", "c")).withColumn("n_near", F.when(F.col("k") == 0, F.col("n_near")).otherwise(0))
    return (each.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.minus")).alias("best_n")))


def with_roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every row of ``forms (word, form)``: the end of the chain from each word, by doubled steps.

    A form occurs at least twice as often as its word, so chains are short and have no loop; steps double each round.
    """
    links = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = checkpointed(links.join(broadcast_if_small(ahead, 64), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """One row per word of the texts: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are maximal runs of A-Z, a-z and U+00C0-U+00FF with A-Z in lower case, one code point taken out of some
    (``as_written``), of at least ``min_length`` code points that occur at least ``min_count`` times.  Two words are near if
    they differ by exactly one inserted, deleted or replaced code point.  ``form`` is the near word that occurs most (of
    equally frequent ones the first in code-point order) if it occurs at least ``ratio`` times as often, else null.

    Null and empty texts have no words; a null id counts as an empty one; rows that repeat count each time; texts and words
    of any length are handled in pieces; an empty table gives an empty result; further columns aren't looked at.  Rotations
    over ``TEXT_ROTATION`` letters are told apart by 124 bits of hash on each side, so that a word of n letters takes
    n rows of fixed width; all others are compared as they are.
    """
    words = checkpointed(word_counts(docs, id, text, min_length, min_count))
    near = checkpointed(near_words(words))
    all_words = words.join(near, "word", "left")
    fits = F.col("best_n") >= ratio * F.col("n")
    formed = checkpointed(all_words.select("word", F.when(fits, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                                           F.when(fits, F.col("best_n")).alias("form_n")))
    roots = with_roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
