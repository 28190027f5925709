"""Column functions for filters, defaults, bands and first-match rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.functions.text import quote, trim_ws, whole_word


def contains_ci(c: Column, literal: str) -> Column:
    return F.contains(F.lower(c), F.lit(literal.lower()))


def matches_word_ci(c: Column, word: str) -> Column:
    return F.lower(c).rlike(whole_word(quote(word.lower())))


def coalesce_empty(c: Column, alternative: Column) -> Column:
    return F.when(c != "", c).otherwise(alternative)


def build_text(cols: list[Column], sep: str = " ") -> Column:
    return trim_ws(F.array_join(F.filter(F.array(*cols), lambda x: x != ""), sep))


def bucket(value: Column, bounds: list, labels: list[str]) -> Column:
    """Closed upper bounds; the last label takes the rest."""
    chain = reduce(lambda acc, bl: acc.when(value <= bl[0], bl[1]), zip(bounds[1:], labels[1:]),
                   F.when(value <= bounds[0], labels[0]))
    return chain.otherwise(labels[-1])


def length_bucket(c: Column, bounds=None, labels=None) -> Column:
    return bucket(F.length(c), bounds or K.LENGTH_BOUNDS, labels or K.LENGTH_LABELS)


def complexity_bucket(c: Column) -> Column:
    return bucket(F.length(c), K.COMPLEXITY_BOUNDS, K.COMPLEXITY_LABELS)


def band(value: Column, bands: list[tuple], strict: bool = False) -> Column:
    """Label by lower bound, highest bound first; the last band takes the rest."""
    tests = [(value > low if strict else value >= low, label) for low, label in bands[:-1]]
    chain = reduce(lambda acc, t: acc.when(t[0], t[1]), tests[1:], F.when(tests[0][0], tests[0][1]))
    return chain.otherwise(bands[-1][1])


def cast_or_default(c: Column, type_name: str, default) -> Column:
    return F.coalesce(trim_ws(c).try_cast(type_name), F.lit(default).cast(type_name))


def parse_date_lenient(c: Column, formats=("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def distinctiveness_band(c: Column) -> Column:
    return band(c, K.DISTINCTIVENESS_BANDS)


def topic_size_band(pct: Column) -> Column:
    return band(pct, K.SIZE_BANDS, strict=True)


def coherence_band(c: Column, low: float = 0.25, high: float = 0.35) -> Column:
    return F.when(c < low, "LOW").when(c < high, "MEDIUM").otherwise("HIGH")


def confidence_band(c: Column, low: float = 0.3, high: float = 0.5) -> Column:
    return F.when(c < low, "LOW").when(c > high, "HIGH").otherwise("OK")


def confidence_bucket(c: Column) -> Column:
    return band(c, K.CONFIDENCE_BUCKETS)


def keyword_rule(alternatives: list[list[str]], keywords: Column) -> Column:
    """One rule of the naming tables as a Boolean column.

    ``=w`` asks for the keyword ``w``, ``~p`` for the phrase ``p`` in the
    keywords joined by spaces.  Alternatives are OR-ed, their parts AND-ed.
    """
    joined = F.array_join(keywords, " ")

    def test(part: str) -> Column:
        return F.array_contains(keywords, part[1:]) if part[0] == "=" else F.contains(joined, F.lit(part[1:]))

    every = [reduce(Column.__and__, [test(p) for p in parts]) for parts in alternatives]
    return reduce(Column.__or__, every)


def first_match(rules: list[tuple], keywords: Column, pick: int) -> Column:
    """Column of the first rule that holds; null when none does."""
    chain = F
    for rule in rules:
        chain = chain.when(keyword_rule(rule[2], keywords), F.lit(rule[pick]))
    return chain
