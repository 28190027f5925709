"""Column functions that clean text.  All run inside the JVM except the two
that need the Python standard library (HTML entities, Unicode NFKD)."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tasksieve import constants as K


def let(c: Column, body) -> Column:
    """``body(value of c)``, with ``c`` computed once however often the body uses it."""
    return F.transform(F.array(c), body)[0]


def holds(c: Column, needed: list[str] | str) -> Column:
    if isinstance(needed, str):
        return c.rlike(needed)
    return reduce(Column.__or__, [c.contains(part) for part in needed])


def _sub(c: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """Regex replace; ``d`` keeps ``\\n`` the only line end, ``U`` makes classes Unicode.

    A text that lacks what the pattern needs is passed through unsearched.
    """
    escaped = replacement.replace("\\", "\\\\").replace("$", "\\$")

    def replaced(t: Column) -> Column:
        return F.regexp_replace(t, f"(?Ud{flags}){pattern}", escaped)

    needed = K.NEEDS.get(pattern)
    return replaced(c) if needed is None else let(c, lambda t: F.when(holds(t, needed), replaced(t)).otherwise(t))


def quote(literal: str) -> str:
    """Escape a literal for Java and RE2 patterns alike."""
    return "".join(ch if ch.isalnum() or ch in " _" or ord(ch) > 127 else "\\" + ch for ch in literal)


def whole_word(term_pattern: str) -> str:
    return f"(?<!{K.WORD})(?:{term_pattern})(?!{K.WORD})"


def trim_ws(c: Column) -> Column:
    """Strip every kind of Unicode white space at both ends."""
    return F.btrim(c, F.lit(K.BLANKS))


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def unescape_html(c: Column) -> Column:
    """Only texts that hold an ``&`` travel to Python; the others are sent as null."""
    return F.coalesce(_unescape(F.when(c.contains("&"), c)), c)


def html_to_text(c: Column) -> Column:
    return _sub(unescape_html(c), r"<[^>]+>", " ")


def strip_boilerplate(c: Column, patterns=None, deep_link_host: str | None = None,
                      example_names: tuple[str, ...] = ()) -> Column:
    """Apply the patterns in order, each to a space.

    ``deep_link_host`` adds links without a scheme to one tracker host;
    ``example_names`` adds the example sentence of a form that names them.
    """
    steps = list(K.BOILERPLATE if patterns is None else patterns)
    if deep_link_host:
        at = next((i + 1 for i, (p, _) in enumerate(steps) if p.startswith("https?")), len(steps))
        steps.insert(at, (quote(deep_link_host) + r"/\S*", ""))
    steps += [(rf"e\.g\.,?\s*[^.:\n]*?{quote(n)}[^.:\n]*", "i") for n in example_names]
    return reduce(lambda acc, step: _sub(acc, step[0], " ", step[1] + ("u" if "i" in step[1] else "")), steps, c)


def strip_greetings(c: Column) -> Column:
    """Early variant: drop greeting and closing phrases."""
    return _sub(c, "(?:" + "|".join(K.GREETINGS) + ")", " ", "iu")


def strip_form_labels(c: Column, labels=None) -> Column:
    return _sub(c, "^(?:" + "|".join(labels or K.FORM_LABELS) + r")\s*$", "", "imu")


def strip_noise_answers(c: Column, words=None) -> Column:
    return _sub(c, "^(?:" + "|".join(words or K.NOISE_ANSWERS) + r")\s*$", "", "imu")


def strip_unicode_rules(c: Column) -> Column:
    return _sub(c, K.RULE_CHARS, "")


def squeeze_blanks(c: Column) -> Column:
    """Runs of blanks and tabs become one blank; a text without two blanks or a tab is not searched."""
    return let(c, lambda t: F.when(t.contains("  ") | t.contains("\t"), F.regexp_replace(t, r"[ \t]{2,}", " ")).otherwise(t))


def collapse_ws(c: Column, everything: bool = False) -> Column:
    """Squeeze blanks and empty lines; ``everything`` turns all white space into one space."""
    if everything:
        return trim_ws(F.regexp_replace(c, rf"{K.SPACE}+", " "))
    return trim_ws(let(squeeze_blanks(c), lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)))


def clean_notes(c: Column, patterns=None, labels=None, noise=None, deep_link_host=None,
                example_names: tuple[str, ...] = (), markup: bool = True) -> Column:
    """HTML, boilerplate, form labels, noise answers, ruler characters, white space."""
    out = html_to_text(c) if markup else c
    out = strip_boilerplate(out, patterns, deep_link_host, example_names)
    out = strip_noise_answers(strip_form_labels(out, labels), noise)
    return collapse_ws(strip_unicode_rules(out))


def extract_field(c: Column, label: str) -> Column:
    """Text after a label line up to the next ``Label:`` line or the end.

    Case is ignored throughout, so the next label may start with any letter.  A text without the signs in the label,
    which have no case, is not searched.
    """
    pattern = rf"(?Udisu){quote(label)}\s*\n(.*?)(?=\n[A-Z][^\n:]{{2,80}}[?]?:|\z)"
    signs = max(re.findall(r"[!-/:-@]+", label), key=len, default="")
    return let(c, lambda t: F.when(t.contains(signs), trim_ws(F.regexp_extract(t, pattern, 1))).otherwise(F.when(t.isNotNull(), "")))


def lowercase(c: Column) -> Column:
    return F.lower(c)


def normalize_unicode(c: Column) -> Column:
    """NFKD, then drop markdown marks."""
    return F.regexp_replace(_nfkd(c), "[*_~`]", "")


def collapse_placeholders(c: Column) -> Column:
    """``[X] [X] [X]`` becomes ``[X]``."""
    return F.regexp_replace(c, r"(\[[A-Z_]+\])(?:\s+\1)+", "$1")


def mask_structural(c: Column, masks=None, deep_link_host: str | None = None, pad: bool = True) -> Column:
    """Ordered structural masks; the order matters (mail before URL, labelled before bare numbers)."""
    steps = list(K.STRUCTURAL_MASKS if masks is None else masks)
    if deep_link_host:
        steps.insert(2, (quote(deep_link_host) + r"/\S*", False, "[URL]"))
    fill = " {} " if pad else "{}"

    def masked(acc: Column, some: list) -> Column:
        return reduce(lambda t, s: _sub(t, s[0], fill.format(s[2]), "iu" if s[1] else ""), some, acc)

    def masked_where(acc: Column, needed, some: list) -> Column:
        return let(acc, lambda t: F.when(holds(t, needed), masked(t, some)).otherwise(t))

    out = c
    for needed, group in groupby(steps, key=lambda s: K.NEEDS.get(s[0])):
        some = list(group)
        # a text that lacks what all of them need is changed by none
        out = masked_where(out, needed, some) if len(some) > 1 and needed == K.FOUR_DIGITS else masked(out, some)
    return trim_ws(squeeze_blanks(out))


def prepare_for_scoring(c: Column, mask: bool = True) -> Column:
    """The text a classifier sees.  With ``mask`` it is masked as in training."""
    return collapse_ws(F.lower(mask_structural(c) if mask else c), everything=True)


def truncate_text(c: Column, n: int, ellipsis: str = "") -> Column:
    cut = F.substring(c, 1, n)
    return F.when(F.length(c) > n, F.concat(cut, F.lit(ellipsis))).otherwise(cut) if ellipsis else cut
