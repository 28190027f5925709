"""Name variants, masking rules drawn from the data, dictionary masking, PII scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.functions.text import holds, quote, squeeze_blanks, trim_ws
from tasksieve.operators.features import token_counts
from tasksieve.session import checkpointed, unfold

REGEX_RULES = 2_000


def _words(c: Column) -> Column:
    return F.filter(F.split(trim_ws(c), rf"{K.SPACE}+"), lambda w: w != "")


def _initials(words: Column, skip: list[str]) -> Column:
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(skip))
    return F.array_join(F.transform(kept, lambda w: F.upper(F.substring(w, 1, 1))), "")


def _core(name: Column, suffix: str) -> Column:
    cut = trim_ws(F.regexp_replace(name, f"(?Ui){suffix}", ""))
    return trim_ws(F.regexp_replace(cut, r"^,+|,+\z", ""))


def variants_of(name: Column, skip: list[str] | None = None) -> Column:
    """The forms of a name, as an array: itself, without business suffix, first
    word, last word, first two words, initials; nothing below three characters."""
    skip = K.NAME_SKIP if skip is None else skip
    full = trim_ws(name)
    words = _words(full)
    many = F.size(words) >= 2
    core = _core(full, K.BUSINESS_SUFFIX)
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    two = F.array_join(F.slice(words, 1, 2), " ")
    initials = _initials(words, skip)
    candidates = F.array(
        full,
        F.when((core != full) & (F.length(core) >= 3), core),
        F.when(many & (F.length(first) >= 4), first),
        F.when(many & (F.length(last) >= 4), last),
        F.when(many & (F.length(two) >= 5), two),
        F.when(many & (F.length(initials) >= 3), initials),
    )
    return F.array_distinct(F.filter(candidates, lambda v: v.isNotNull() & (F.length(v) >= 3) & ~F.lower(v).isin(skip)))


def wide_variants_of(name: Column, skip: list[str] | None = None) -> Column:
    """The wider form: suffix-free core, initials of name and core, no punctuation."""
    skip = K.NAME_SKIP_WIDE if skip is None else skip
    full = trim_ws(name)
    core = _core(full, K.BUSINESS_SUFFIX_WIDE)
    plain = trim_ws(F.regexp_replace(full, rf"[^\p{{L}}\p{{N}}_\s]", ""))

    def initials(text: Column) -> Column:
        out = _initials(_words(text), skip)
        return F.when(F.length(out) >= 3, out)

    candidates = F.array(full, F.when(core != full, core), initials(full), initials(core), plain)
    return F.array_distinct(F.filter(candidates, lambda v: v.isNotNull() & (F.length(v) >= 3)
                                     & ~F.lower(v).isin(skip) & ~v.rlike(r"^\p{Nd}+$")))


def name_variants(names: DataFrame, name: str = "name", skip: list[str] | None = None) -> DataFrame:
    """``(name, variant)``."""
    return names.select(F.col(name).alias("name"), F.explode(variants_of(F.col(name), skip)).alias("variant"))


def name_variants_v2(names: DataFrame, name: str = "name", skip: list[str] | None = None) -> DataFrame:
    """``(name, variant)`` with the wider forms."""
    return names.select(F.col(name).alias("name"), F.explode(wide_variants_of(F.col(name), skip)).alias("variant"))


def _person(cell: Column, wide: bool) -> Column:
    """A person's name; mail addresses are left out or, when wide, read as names."""
    local = F.initcap(F.regexp_replace(F.split_part(cell, F.lit("@"), F.lit(1)), "[._]", " "))
    return F.when(~cell.contains("@"), cell).otherwise(local if wide else F.lit(None))


def _staff_forms(name: Column) -> Column:
    """Full name, and the first name when it has four letters or more."""
    words = F.split(name, rf"{K.SPACE}+")
    first = F.when((F.size(words) >= 2) & (F.length(words[0]) >= 4), words[0])
    return F.when(F.length(name) >= 3, F.array_compact(F.array(name, first)))


def derive_mask_rules(df: DataFrame, household: str = "household", assignee: str = "assignee",
                      skip: list[str] | None = None, generic: list[str] = (), wide: bool = False) -> DataFrame:
    """``(variant, placeholder)`` from the distinct values of two metadata columns.

    Cells are split at commas and expanded into variants.  A variant that occurs
    more than once, regardless of case, is kept once: the longest wins, then the
    client over the employee.  ``wide`` uses the wider variants and reads mail
    addresses as names; ``generic`` lists variants too common to mask.  Both
    columns are read in one scan and made distinct before anything else.
    """
    skip = list(K.HOUSEHOLD_SKIP if skip is None else skip)
    shortest = 1 if wide else 3
    parts = F.filter(F.transform(F.split(household, ","), trim_ws), lambda p: (F.length(p) >= shortest) & ~F.lower(p).isin(skip))
    people = F.filter(F.array(_person(trim_ws(F.col(assignee)), wide)), lambda p: p.isNotNull() & (p != ""))
    cells = F.concat(F.transform(parts, lambda p: F.struct(F.lit(0).alias("source"), p.alias("name"))),
                     F.transform(people, lambda p: F.struct(F.lit(1).alias("source"), p.alias("name"))))
    names = unfold(df.select(household, assignee).distinct(), cells, "x").select("x.*").distinct()
    name, client = F.col("name"), F.col("source") == 0
    if wide:
        forms = wide_variants_of(name)
        forms = F.when(client, F.filter(forms, lambda v: ~F.lower(v).isin(list(generic)))).otherwise(forms) if generic else forms
    else:
        forms = F.when(client, variants_of(name)).otherwise(_staff_forms(name))
    variants = unfold(names, forms, "variant", "source")
    best = F.min(F.struct((-F.length("variant")).alias("m"), "source", "variant")).alias("b")
    return (variants.groupBy(F.lower("variant").alias("key")).agg(best)
            .select("b.variant", F.when(F.col("b.source") == 0, "[CLIENT]").otherwise("[EMPLOYEE]").alias("placeholder")))


#: Letters that equal an ASCII letter without case (dotted and dotless i, long s, Kelvin sign).
ODD_ASCII = "\u0130\u0131\u017f\u212a"


def alternation(terms: list[str], guarded: tuple[str, ...] = ()) -> str:
    """One whole-word pattern over all terms, longest first.

    A ``guarded`` term only asks that no ASCII letter follows it.  If all terms begin with an ASCII letter or digit,
    the letter at a place is looked at first, as a plain set.
    """
    guarded = tuple(g.lower() for g in guarded)
    parts = []
    for term in sorted(set(terms), key=lambda t: (-len(t), t.lower())):
        right = "(?![a-zA-Z])" if term.lower() in guarded else f"(?!{K.WORD})"
        parts.append(quote(term) + right)
    firsts = {term[:1] for term in terms}
    ahead = ""
    if all(f.isascii() and f.isalnum() for f in firsts):
        ahead = "(?-iu:(?=[" + "".join(sorted({x for f in firsts for x in (f.lower(), f.upper())})) + ODD_ASCII + "]))"
    return f"(?iu){ahead}(?<!{K.WORD})(?:{'|'.join(parts)})"


def _alike() -> dict[str, str]:
    """Letters that lower case alone does not bring together with those they equal without case (long s and s)."""
    found = {"\u0130": "i", "\u1e9e": "\u00df"}
    for c in map(chr, range(0x10000)):
        once = c.upper()
        if len(once) == 1 and len(once.lower()) == 1 and once.lower() != c.lower():
            found[c] = once.lower()
    return found


ALIKE = _alike()


def fold(c: Column) -> Column:
    """Texts that the case-insensitive pattern takes as equal become equal.

    The pattern compares letter by letter through upper and then lower case.
    """
    return F.translate(F.lower(F.translate(c, "".join(ALIKE), "".join(ALIKE.values()))), "\u03c2", "\u03c3")


def folded_map(pairs: list[tuple[str, str]]) -> Column:
    """A literal map from folded terms to values; of terms that fold alike the last counts."""
    folded = {t.translate(str.maketrans(ALIKE)).lower().replace("\u03c2", "\u03c3"): v for t, v in pairs}
    return F.create_map(*[F.lit(x) for pair in folded.items() for x in pair])


def _placeholder_of(rules: list[tuple[str, str]], unknown: str = "[MASKED]"):
    """What stands for a match; never null, so that nothing around a match can get lost."""
    lookup = folded_map(rules)
    return lambda matched: F.coalesce(F.try_element_at(lookup, fold(matched)), F.lit(unknown))


def mask_with_terms(c: Column, rules: list[tuple[str, str]], pad: bool = True) -> Column:
    """Replace terms by their placeholder in one pass, leftmost and longest first."""
    if not rules:
        return c
    from tasksieve.operators.entities import pieces

    placeholder = _placeholder_of(rules)
    fill = (lambda p: F.concat(F.lit(" "), p, F.lit(" "))) if pad else (lambda p: p)

    def rebuild(gaps: Column, hits: Column) -> Column:
        behind = F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1)))
        tail = F.zip_with(hits, behind, lambda h, g: F.concat(fill(placeholder(h)), g))
        return F.concat(gaps[0], F.array_join(tail, ""))

    masked = pieces(c, alternation([t for t, _ in rules]), rebuild)
    return trim_ws(squeeze_blanks(masked)) if pad else masked


def mask_dictionary(df: DataFrame, c: str, rules: DataFrame, out: str | None = None,
                    strategy: str = "auto", id_col: str = "task_id") -> DataFrame:
    """Mask the dictionary terms of ``rules (variant, placeholder)`` in column ``c``.

    One meaning whatever the number of rules: whole words, any case, leftmost place and then longest term, over
    all terms at once.  Up to ``REGEX_RULES`` rules become one pattern and the texts are only read; more
    are found by walking the trie of the terms (``dictionary_hits``), each distinct text once.  Of
    rules for the same term the first placeholder in order counts, a missing one is ``[MASKED]``.
    """
    from tasksieve.operators.entities import dictionary_spans, replace_spans

    out = out or c
    if strategy != "join":
        few = rules.select("variant", "placeholder").limit(REGEX_RULES + 1).collect()
        if len(few) > REGEX_RULES and strategy == "regex":
            raise ValueError(f"more than {REGEX_RULES} rules: use the join")
        strategy = "regex" if len(few) <= REGEX_RULES else "join"
    if strategy == "regex":
        pairs = sorted(((r["variant"], r["placeholder"] or "[MASKED]") for r in few if r["variant"]), key=lambda r: r[1], reverse=True)
        return df.withColumn(out, mask_with_terms(F.col(c), pairs))
    entries = rules.select(F.col("variant").alias("name"), F.coalesce("placeholder", F.lit("[MASKED]")).alias("category"))
    keyed = df.withColumn("__key", F.sha2(F.col(c).cast("binary"), 256))
    distinct = keyed.filter(F.col(c).isNotNull()).groupBy("__key").agg(F.first(c).alias("text"))
    spans = dictionary_spans(checkpointed(distinct), "text", entries, id_col="__key").withColumnRenamed("spans", "__spans")
    filled = replace_spans(F.col(c), F.col("__spans"), lambda s: F.concat(F.lit(" "), s["category"], F.lit(" ")))
    masked = F.when(F.col("__spans").isNull(), F.col(c)).otherwise(filled)
    return (keyed.join(spans, "__key", "left")
            .withColumn(out, trim_ws(F.regexp_replace(masked, r"[ \t]{2,}", " "))).drop("__spans", "__key"))


def luhn_ok(c: Column) -> Column:
    """Check digit of a card number, over its digits from the right."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(c, r"\D", "")), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def _detection(kind: str, score: float, placeholder: str):
    return lambda s: F.struct(
        s["start"].alias("start"), (s["start"] - s["end"]).alias("minus_len"), F.lit(kind).alias("entity_type"),
        s["end"].alias("end"), F.lit(score).alias("score"), s["entity"].alias("text"), F.lit(placeholder).alias("placeholder"))


DETECTION = "array<struct<start:int,minus_len:int,entity_type:string,end:int,score:double,text:string,placeholder:string>>"


def detect_pii(df: DataFrame, c: str, detectors=None, min_score: float = 0.85, out: str | None = None,
               found: str = "detections") -> DataFrame:
    """Adds the masked text and the array of detections it was masked by."""
    from tasksieve.operators.entities import keep_first_of_overlaps, replace_spans, spans_of

    def spans_by(kind: str, pattern: str, score: float, placeholder: str, needed) -> Column:
        spans = spans_of(F.col(c), f"(?U){pattern}", needed)
        if kind == "CREDIT_CARD":
            spans = F.filter(spans, lambda s: luhn_ok(s["entity"]))
        return F.transform(spans, _detection(kind, score, placeholder))

    used = [d for d in detectors or K.DETECTORS if d[2] >= min_score]
    digits = [d for d in used if K.NEEDS.get(d[1]) == K.FOUR_DIGITS]
    lists = [spans_by(*d, K.NEEDS.get(d[1])) for d in used if d not in digits]
    if digits:  # what they need is looked for once
        all_of = F.concat(*[spans_by(*d, None) for d in digits])
        lists.append(F.when(holds(F.col(c), K.FOUR_DIGITS), all_of).otherwise(F.array().cast(DETECTION)))
    scanned = df.withColumn(found, keep_first_of_overlaps(F.array_sort(F.concat(*lists))))
    return scanned.withColumn(out or c, replace_spans(F.col(c), F.col(found), lambda s: s["placeholder"]))


def detection_log(df: DataFrame, found: str = "detections", id_col: str = "task_id") -> DataFrame:
    return unfold(df, F.col(found), "d", id_col).select(
        id_col, "d.entity_type", "d.start", "d.end", "d.score", "d.text")


def pii_scan(df: DataFrame, c: str, detectors=None, min_score: float = 0.85, id_col: str = "task_id",
             out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Masked texts and a detection log from pattern detectors with fixed scores.

    Returns ``(df with masked column, log(task_id, entity_type, start, end, score, text))``.
    A card number has to pass its check digit.  Overlaps go to the leftmost,
    then longest detection.
    """
    scanned = detect_pii(df, c, detectors, min_score, out, "__pii")
    return scanned.drop("__pii"), detection_log(scanned, "__pii", id_col)


def placeholder_counts(df: DataFrame, c: str, placeholders: list[str]) -> DataFrame:
    """Occurrences of each placeholder, one pass."""
    sums = df.agg(*[F.coalesce(F.sum(F.regexp_count(c, F.lit(quote(p)))), F.lit(0)).cast("bigint").alias(f"p{i}")
                    for i, p in enumerate(placeholders)])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("placeholder"), F.col(f"p{i}").alias("n")) for i, p in enumerate(placeholders)])))


def masking_impact(df: DataFrame, raw: str, masked: str, k: int = 10, stop=None) -> DataFrame:
    """Top tokens before and after masking, by rank."""
    def top(column: str, words: list[str], suffix: str) -> DataFrame:
        counts = token_counts(df, column, stop=words, id_free=True)
        first = counts.orderBy(F.desc("n"), "token").limit(k)
        ranked = first.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "token"))).alias("all"))
        return ranked.select(F.posexplode("all").alias("i", "x")).select(
            (F.col("i") + 1).cast("bigint").alias("rank"), F.col("x.token").alias(f"token_{suffix}"),
            (-F.col("x.m")).alias(f"n_{suffix}"))

    after_stop = K.MASKED_STOP_WORDS if stop is None else stop
    return top(raw, [], "before").join(top(masked, after_stop, "after"), "rank", "full")
