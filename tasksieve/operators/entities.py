"""Entity spans, their removal with an audit log, and platform assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.functions.text import holds, let, quote, trim_ws
from tasksieve.operators.masking import ALIKE, alternation, fold, folded_map
from tasksieve.session import BROADCAST_BYTES, checkpointed, unfold

SPAN = "array<struct<entity:string,category:string,start:int,end:int>>"


#: A character that stands around the matches of a pattern, rare in texts.
MARK = "\x01"


def pieces(c: Column, pattern: str, body) -> Column:
    """``body(gaps, hits)``: the text between the matches of a pattern, and the matches.

    The pattern is searched for once: matches are put between marks and the text is split at these.  A text that
    holds the mark itself, or an empty match, is searched for matches and for gaps.
    """
    def twice(t: Column) -> Column:
        return F.struct(F.split(t, pattern, -1).alias("gaps"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hits"))

    def once(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, pattern, f"{MARK}$0{MARK}"), MARK, -1)
        return let(parts, lambda p: let(F.filter(p, lambda _, i: i % 2 == 1), lambda hits: F.when(
            F.exists(hits, lambda h: h == ""), twice(t)).otherwise(F.struct(F.filter(p, lambda _, i: i % 2 == 0).alias("gaps"), hits.alias("hits")))))

    return let(c, lambda t: let(F.when(t.contains(MARK), twice(t)).otherwise(once(t)), lambda x: body(x["gaps"], x["hits"])))


#: Long arrays are walked in blocks of this many items.
BLOCK = 256


def scan(items: Column, state: Column, kind: str, step) -> Column:
    """One output an item, each from a running state: ``step(state, item) -> (state, output)``.

    Appending to an array copies it, so outputs are gathered per block and the blocks joined at the end.
    """
    blocks = let(items, lambda held: F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(held) - 1, F.lit(0)) / BLOCK).cast("int")),
        lambda i: F.slice(held, i * BLOCK + 1, F.lit(BLOCK))))

    def walk(acc: Column, block: Column) -> Column:
        def one(inner: Column, item: Column) -> Column:
            after, output = step(inner["state"], item)
            return F.struct(after.alias("state"), F.concat(inner["out"], F.array(output)).alias("out"))

        return F.aggregate(block, F.struct(acc["state"].alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one,
                           lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    return F.aggregate(blocks, F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), walk,
                       lambda acc: F.flatten(acc["out"]))


def with_cuts(c: Column, n: Column, body) -> Column:
    """``body(cut)``, where ``cut(start, length)`` reads a part of the text, ``start`` from 0.

    A substring is found by walking from the beginning; a text cut in more than ``BLOCK`` places
    is taken apart into its characters once instead.
    """
    few = body(lambda start, length: F.substring(c, start + 1, length))
    many = let(F.split(c, ""), lambda chars: body(
        lambda start, length: F.array_join(F.slice(chars, F.greatest(start, F.lit(0)) + 1, F.greatest(length, F.lit(0))), "")))
    return F.when(F.coalesce(n, F.lit(0)) <= BLOCK, few).otherwise(many)


def replace_spans(c: Column, spans: Column, filler) -> Column:
    """The text with each span (sorted, without overlaps) replaced by ``filler(span)``."""
    def rebuilt(x: Column) -> Column:
        text, size, held = x["text"], x["size"], x["spans"]

        def rebuild(cut):
            tail = F.transform(held, lambda s, i: F.concat(filler(s), cut(s["end"], F.coalesce(F.get(held, i + 1)["start"], size) - s["end"])))
            return F.concat(cut(F.lit(0), F.coalesce(F.get(held, F.lit(0))["start"], size)), F.array_join(tail, ""))

        return with_cuts(text, F.size(held), rebuild)

    return let(F.struct(c.alias("text"), F.length(c).alias("size"), spans.alias("spans")), rebuilt)


def spans_of(c: Column, pattern: str, needed=None) -> Column:
    """All matches of a pattern as ``(entity, start, end)``, half-open character offsets.

    The text between the matches gives their places: a match starts after all
    gaps and matches before it.
    """
    empty = F.array().cast("array<struct<entity:string,start:int,end:int>>")

    def walk(gaps: Column, hits: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(1))), hits,
                           lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
        def place(at: Column, x: Column) -> tuple[Column, Column]:
            end = at + x["g"] + F.length(x["h"])
            return end, F.struct(x["h"].alias("entity"), (at + x["g"]).alias("start"), end.alias("end"))

        walked = scan(sizes, F.lit(0), "struct<entity:string,start:int,end:int>", place)
        return F.when(F.size(hits) > 0, walked).otherwise(empty)

    if needed is None:
        return pieces(c, pattern, walk)
    return let(c, lambda t: F.when(holds(t, needed), pieces(t, pattern, walk)).otherwise(empty))


def extract_entities(c: Column, entries: list[tuple[str, str]], guarded: tuple[str, ...] = ()) -> Column:
    """Spans with category; one pass, longest term first, whole words, any case."""
    lookup = folded_map(entries)
    spans = spans_of(c, alternation([t for t, _ in entries], guarded))
    return F.transform(spans, lambda s: F.struct(
        s["entity"].alias("entity"),
        F.coalesce(F.try_element_at(lookup, fold(s["entity"])), F.lit("unknown")).alias("category"),
        s["start"].alias("start"), s["end"].alias("end")))


#: A text, or a term, as its words and single other characters.
TOKEN = rf"{K.WORD}+|(?s:.)"
#: Letters for which folding is more than lower case.
FOLDED = "[" + "".join(ALIKE) + "\u03a3\u03c2]"
#: Most first tokens of a dictionary that texts are searched for before places become rows.
FIRST_TOKENS = 10_000
#: Most first tokens, and tokens ahead, for which one pattern finds the places.
PATTERN_TOKENS = 100


def first_tokens(trie: DataFrame) -> list[str] | None:
    """The tokens that terms begin with, if they are few."""
    rows = trie.filter("depth = 0").select("token").distinct().limit(FIRST_TOKENS + 1).collect()
    return [r["token"] for r in rows] if len(rows) <= FIRST_TOKENS else None


def pattern_places(df: DataFrame, c: str, first: list[str], ahead: int, id_col: str) -> DataFrame:
    """``term_places`` by one pattern over few first tokens; what follows each is read ahead, not consumed."""
    parts = "|".join(map(quote, first))
    one = rf"(?iu)(?<!{K.WORD})(?:{parts})(?:(?<!{K.WORD})|(?!{K.WORD}))"
    follows = rf"{one}(?=((?:{K.WORD}++|(?s:.)){{0,{ahead - 1}}}+))"
    places = F.zip_with(spans_of(F.col(c), one), F.regexp_extract_all(c, F.lit(follows), F.lit(1)), lambda s, more: F.struct(
        s["start"].alias("start"), F.regexp_extract_all(F.concat(s["entity"], more), F.lit(TOKEN), F.lit(0)).alias("ahead")))
    return unfold(df, places, "x", id_col).select(id_col, "x.start", "x.ahead")


def term_places(df: DataFrame, c: str, first: list[str] | None, ahead: int, id_col: str) -> DataFrame:
    """``(id, start, ahead)``: places where a term may begin, no word before them, with the next ``ahead`` tokens.

    With ``first`` given only the places of these tokens become rows.  Only texts that hold a letter of ``FOLDED`` are
    folded, for all others lower case is the same.
    """
    if first and max(len(first), ahead) <= PATTERN_TOKENS:
        return pattern_places(df, c, first, ahead, id_col)
    held = F.col("__p")
    cut = df.select(id_col, F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)).alias("__p"), F.col(c).rlike(FOLDED).alias("__odd"))

    def begins(alike) -> Column:
        open_before = lambda i: ~F.coalesce(F.get(held, i - 1), F.lit("")).rlike(K.WORD)
        wanted = open_before if first is None else lambda i: alike(F.get(held, i)).isin(first) & open_before(i)
        return F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: F.get(held, i).isNotNull() & wanted(i))

    at = begins(F.lower) if first is None else F.when(F.col("__odd"), begins(fold)).otherwise(begins(F.lower))
    # No filter on the places here: it would be pushed below and cut the text anew for every token.
    found = cut.select(id_col, "__p", at.alias("__at"))
    # The text between a place and the one before says where it starts.
    gaps = F.transform("__at", lambda at, i: let(F.coalesce(F.get("__at", i - 1), F.lit(0)), lambda last: F.length(
        F.array_join(F.slice(held, last + 1, at - last), ""))))
    found = found.withColumn("__s", scan(gaps, F.lit(0), "int", lambda at, n: (at + n, at + n)))
    places = F.transform("__at", lambda at, i: F.struct(F.get("__s", i).alias("start"), F.slice(held, at + 1, F.lit(ahead)).alias("ahead")))
    return unfold(found, places, "x", id_col).select(id_col, "x.start", "x.ahead")


def term_trie(dictionary: DataFrame) -> DataFrame:
    """``(depth, parent, token, terms, goes_on)``: the trie of all terms ``(name, category)`` over folded tokens, one row an edge.

    A node is named by the text that leads to it, which stands for one sequence of tokens only, as two words
    never touch.  ``terms`` are those that end with the edge, ``goes_on`` says whether longer ones pass it.
    """
    tokens = dictionary.filter("name <> ''").select("name", "category", F.transform(F.regexp_extract_all("name", F.lit(TOKEN), F.lit(0)), fold).alias("t"))
    steps = tokens.select("name", "category", "t", F.posexplode("t").alias("depth", "token"))
    ends = F.col("depth") == F.size("t") - 1
    return (steps.select("depth", F.expr("array_join(slice(t, 1, depth), '')").alias("parent"), "token", ends.alias("ends"), F.when(ends, F.struct("name", "category")).alias("term"))
            .groupBy("depth", "parent", "token").agg(F.collect_set("term").alias("terms"), F.bool_or(~F.col("ends")).alias("goes_on")))


def _level(trie: DataFrame, depth: int) -> DataFrame:
    """The edges of one depth, for broadcast if they have few bytes."""
    edges = trie.filter(F.col("depth") == depth).drop("depth")
    size = edges.agg(F.sum(64 + F.octet_length("parent") + F.octet_length("token") + F.octet_length(F.to_json("terms")))).first()[0] or 0
    return F.broadcast(edges) if size <= BROADCAST_BYTES else edges


def dictionary_hits(df: DataFrame, c: str, dictionary: DataFrame, guarded: tuple[str, ...] = (), id_col: str = "task_id") -> DataFrame:
    """``(id, name, category, entity, start, end)``: every whole-word place of every term, overlaps too.

    For dictionaries ``(name, category)`` too big for one pattern.  A text is cut into its words and single other
    characters, as the terms are.  Places walk down the trie of the terms, one join a level: a place is at one node at
    most, so its rows don't grow with the number of terms that begin alike, and the walk ends when no place has an edge left.
    The few ``guarded`` terms, which may end inside a word, are searched for one by one.
    """
    special = F.lower("name").isin([g.lower() for g in guarded]) if guarded else F.lit(False)
    trie = checkpointed(term_trie(dictionary.filter(~special)))
    widest = (trie.agg(F.max("depth")).first()[0] or 0) + 1
    # As many tokens ahead as the longest term has, and one more to see whether a word goes on there.
    live = term_places(df, c, first_tokens(trie), widest + 1, id_col).withColumn("parent", F.lit(""))
    hits = []
    for depth in range(widest):
        here = live.withColumn("token", fold(F.get("ahead", F.lit(depth))))
        step = checkpointed(here.join(_level(trie, depth), ["parent", "token"]))
        free = ~F.coalesce(F.get("ahead", F.lit(depth + 1)), F.lit("")).rlike(K.WORD)
        hits.append(step.filter((F.size("terms") > 0) & free).withColumn("term", F.explode("terms")).select(
            id_col, "term.name", "term.category", F.array_join(F.slice("ahead", 1, depth + 1), "").alias("entity"), "start"))
        live = step.filter("goes_on").select(id_col, "start", "ahead", F.concat("parent", "token").alias("parent"))
        if live.isEmpty():
            break
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    found = found.withColumn("end", F.col("start") + F.length("entity"))
    few = dictionary.filter(special).select("name", "category").distinct().collect() if guarded else []  # no more than ``guarded``
    for name, category in few:
        among = unfold(df, spans_of(F.col(c), alternation([name], guarded)), "s", id_col)
        found = found.unionByName(among.select(id_col, F.lit(name).alias("name"), F.lit(category).alias("category"), "s.entity", "s.start", "s.end"))
    return found


def dictionary_spans(df: DataFrame, c: str, dictionary: DataFrame, guarded: tuple[str, ...] = (), id_col: str = "task_id") -> DataFrame:
    """``(id, spans)`` as ``extract_entities`` finds them, by a join with a dictionary of any size.

    Of terms at one place the longest counts, of overlaps the first.  Texts
    without an entity have no row.  Ids must be unique.
    """
    span = F.struct("start", (-F.col("end")).alias("minus"), "category", "entity", "end")
    return dictionary_hits(df, c, dictionary, guarded, id_col).groupBy(id_col).agg(
        keep_first_of_overlaps(F.array_sort(F.collect_list(span))).alias("__k")).select(
        id_col, F.transform("__k", lambda s: F.struct(s["entity"], s["category"], s["start"], s["end"])).cast(SPAN).alias("spans"))


def dictionary_leaks(df: DataFrame, c: str, dictionary: DataFrame, guarded: tuple[str, ...] = (), id_col: str = "task_id") -> DataFrame:
    """``(id, type, value, context)``: the dictionary part of ``leakage_scan`` for a dictionary of any size.

    A term is reported once per text, under its category.
    """
    found = dictionary_hits(df, c, dictionary, guarded, id_col).select(
        id_col, F.col("category").alias("type"), F.lower("name").alias("value")).distinct()
    return found.join(df.select(id_col, F.substring(c, 1, 100).alias("context")), id_col).select(id_col, "type", "value", "context")


def dictionary_entries(dictionary: DataFrame, max_rows: int = 2_000) -> list[tuple[str, str]]:
    """The rows of a dictionary small enough for one pattern."""
    rows = dictionary.select("name", "category").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError("dictionary too big for one pattern: use dictionary_spans")
    return [(r["name"], r["category"]) for r in rows]


def keep_first_of_overlaps(spans: Column) -> Column:
    """Of sorted spans keep each that starts at or after the end of the last one kept."""
    def judge(last: Column, s: Column) -> tuple[Column, Column]:
        keeps = s["start"] >= last
        return F.when(keeps, s["end"]).otherwise(last), keeps

    def kept(held: Column) -> Column:
        zipped = F.zip_with(held, scan(held, F.lit(-1), "boolean", judge), lambda s, mark: F.struct(s.alias("span"), mark.alias("mark")))
        return F.transform(F.filter(zipped, lambda x: x["mark"]), lambda x: x["span"])

    return let(spans, kept)


def resolve_overlaps(spans: Column) -> Column:
    """Sort by start, longest first, and drop what overlaps an earlier span."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                           .otherwise((b["end"] - b["start"]) - (a["end"] - a["start"])))
    return keep_first_of_overlaps(ordered)


def cut_spans(c: Column, spans: Column) -> Column:
    """Delete spans (sorted, without overlaps)."""
    return F.when(F.size(spans) > 0, replace_spans(c, spans, lambda s: F.lit(""))).otherwise(c)


def cleanup_orphans(c: Column) -> Column:
    """Squeeze white space and drop prepositions and conjunctions left at the ends."""
    preps, conj = K.CLEANUP_PREPOSITIONS, "and|or|&"
    out = F.regexp_replace(c, r"(?U)\s{2,}", " ")
    out = F.regexp_replace(out, rf"(?Ui)\s+(?:{preps})\s*\z", "")
    out = F.regexp_replace(out, rf"(?Ui)^\s*(?:{preps})\s+", "")
    out = F.regexp_replace(out, rf"(?Ui)\s+(?:{conj})\s*\z", "")
    out = F.regexp_replace(out, rf"(?Ui)^\s*(?:{conj})\s+", "")
    out = F.regexp_replace(out, r"(?U)\s{2,}", " ")
    out = F.regexp_replace(out, r"(?U)\s*-\s*-\s*", " - ")
    out = F.regexp_replace(out, r"(?U),\s*,", ",")
    return trim_ws(out)


def remove_entities(c: Column, spans: Column) -> Column:
    """Cut the spans and tidy up; a text without spans is only stripped."""
    return F.when(F.size(spans) > 0, cleanup_orphans(cut_spans(c, spans))).otherwise(trim_ws(c))


def _word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[^\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+"))


def removal_flags(text: Column, spans: Column, cleaned: Column) -> Column:
    """Per span, the quality flags of its removal (``array<array<string>>``)."""
    def all_flags(cut, spans: Column) -> Column:
        return F.transform(spans, lambda s, i: flags(cut, spans, s, i))

    def flags(cut, spans: Column, s: Column, i: Column) -> Column:
        # The longest of these prepositions has four letters, so five characters
        # decide; the whole prefix is only looked at behind a long run of blanks.
        close_by = F.rtrim(cut(F.greatest(s["start"] - 32, F.lit(0)), F.least(s["start"], F.lit(32))), F.lit(K.BLANKS))
        before = F.right(F.when((F.length(close_by) > 5) | (s["start"] <= 32), close_by).otherwise(
            F.rtrim(cut(F.lit(0), s["start"]), F.lit(K.BLANKS))), F.lit(5))
        near = F.concat(cut(F.greatest(s["start"] - 5, F.lit(0)), F.least(s["start"], F.lit(5))), F.lit(" "), cut(s["end"], F.lit(5)))
        left = F.try_element_at(spans, F.greatest(i, F.lit(1)))
        right = F.try_element_at(spans, i + 2)
        close = (
            ((i > 0) & (_word_count(cut(left["end"], s["start"] - left["end"])) <= 3))
            | (right.isNotNull() & (_word_count(cut(s["end"], right["start"] - s["end"])) <= 3)))
        return F.array_compact(F.array(
            F.when(before.rlike(rf"(?Ui)\b(?:{K.FLAG_PREPOSITIONS})\z"), "trailing_preposition"),
            F.when(near.rlike(r"(?U)\d"), "numeric_adjacent"),
            F.when(F.coalesce(close, F.lit(False)), "adjacent_removal")))

    # Decided once per row, outside the per-span function.
    found = let(F.struct(text.alias("text"), spans.alias("spans")), lambda x: with_cuts(
        x["text"], F.size(x["spans"]), lambda cut: all_flags(cut, x["spans"])))
    return F.when(F.length(trim_ws(cleaned)) < 10, F.transform(found, lambda f: F.array_append(f, "short_result"))).otherwise(found)


def anonymization_log(df: DataFrame, text: str, spans: str, id_col: str = "task_id") -> DataFrame:
    """One row per removal.

    The context shows ten characters either side.  On the right the removals
    that follow have already happened, as removal runs from right to left.
    """
    c, s = F.col(text), F.col(spans)
    cleaned = remove_entities(c, s)
    base = df.filter(F.size(s) > 0).select(
        F.col(id_col), c.alias("original_text"), s.alias("__spans"), cleaned.alias("cleaned_text"))
    c, s = F.col("original_text"), F.col("__spans")
    flagged = F.zip_with(s, removal_flags(c, s, F.col("cleaned_text")), lambda x, f: F.struct(x.alias("s"), f.alias("f")))

    # What follows each removal, found in one pass from the last one back.
    def sides(cut, held: Column) -> Column:
        """Ten characters ahead of each span, and the gap behind it up to ten."""
        return F.transform(held, lambda x, i: F.struct(
            cut(F.greatest(x["start"] - 10, F.lit(0)), F.least(x["start"], F.lit(10))).alias("ahead"),
            cut(x["end"], F.least(F.coalesce(F.get(held, i + 1)["start"] - x["end"], F.lit(10)), F.lit(10))).alias("gap")))

    def follow(rest: Column, x: Column) -> tuple[Column, Column]:
        rest = F.substring(F.concat(x["gap"], rest), 1, 10)
        return rest, rest

    around = let(F.struct(c.alias("text"), s.alias("spans")), lambda x: with_cuts(
        x["text"], F.size(x["spans"]), lambda cut: sides(cut, x["spans"])))
    base = base.withColumn("__around", around).withColumn(
        "__behind", F.reverse(scan(F.reverse("__around"), F.lit(""), "string", follow)))

    context = F.zip_with("__around", "__behind", lambda a, b: F.struct(a["ahead"].alias("ahead"), b.alias("behind")))
    entries = F.zip_with(flagged, context, lambda z, x: F.struct(
        z["s"]["entity"].alias("entity_removed"), z["s"]["category"].alias("category"),
        z["s"]["start"].alias("span_start"), z["s"]["end"].alias("span_end"),
        F.concat(x["ahead"], z["s"]["entity"], x["behind"]).alias("context_window"),
        z["f"].alias("flags")))
    return (unfold(base, entries, "e", id_col, "original_text", "cleaned_text")
            .select(id_col, "original_text", "e.entity_removed", "e.category", "e.span_start", "e.span_end",
                    "e.context_window", "e.flags", "cleaned_text"))


def assign_platform(spans: Column, tracked: list[str], default: str = "General") -> Column:
    """First and second mention of a tracked platform, in its canonical spelling.

    Only bare names count, and the second mention may repeat the first.
    """
    canonical = F.create_map(*[F.lit(x) for name in tracked for x in (name.lower(), name)])
    found = F.filter(F.transform(spans, lambda s: F.try_element_at(canonical, F.lower(s["entity"]))),
                     lambda p: p.isNotNull())
    return F.struct(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(default)).alias("primary_platform"),
                    F.try_element_at(found, F.lit(2)).alias("secondary_platform"))
