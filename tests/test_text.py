"""Cleaning functions on literal texts."""

import html
import random

import pytest
from pyspark.sql import functions as F

from tasksieve import constants as K
from tasksieve.functions import conditions as C
from tasksieve.functions import text as X


@pytest.fixture(scope="module")
def value(spark):
    def run(expression, *texts):
        out = spark.createDataFrame([(t,) for t in texts], "t string").select(expression(F.col("t")).alias("v")).collect()
        return [r.v for r in out] if len(texts) > 1 else out[0].v

    return run


def test_boilerplate_goes(value):
    notes = ("Email address:\na@b.co\n\nHow may we assist you?:\nNew account\n\nPlease select the priority level for this request.:\nMedium\n\n"
             "Need &amp; want <b>this</b>\nBest regards,\nSomeone\n---\nThis task was submitted through a form\nhttps://x.y/z")
    out = value(X.clean_notes, notes)
    assert "Medium" not in out and "Email address" not in out and "regards" not in out and "submitted" not in out
    assert "New account" in out and "Need & want this" in out.replace("  ", " ")


def test_field_extraction(value):
    notes = "Name:\nX\nHow may we assist you?:\nline one\nline two\n\nPlease specify.:\nthe detail"
    assert value(lambda c: X.extract_field(c, K.INTENT_LABELS[0]), notes) == "line one\nline two"
    assert value(lambda c: X.extract_field(c, K.DETAIL_LABEL), notes) == "the detail"
    assert value(lambda c: X.extract_field(c, "No such label:"), notes) == ""


def test_structural_masks(value):
    masked = value(X.mask_structural, "Write x.y@z.com, see https://a.b/c?d or www.q.com, account id: 123456, 1234567890, (212) 555-0100")
    assert masked == "Write [EMAIL] , see [URL] or [URL] [ID] , [ID] , [PHONE]"
    assert value(lambda c: X.mask_structural(c, deep_link_host="tracker.example"), "go tracker.example/0/12 now") == "go [URL] now"


def test_trim_knows_unicode_blanks(value):
    assert value(X.trim_ws, "  \t a b 　\n\x85") == "a b"
    assert value(X.trim_ws, "") == ""


def test_unescape_is_the_standard_one(value):
    texts = ["a &lt; b &amp;lt; c", "caf&eacute; &copy 1", "plain", "&#8364;5 &notanentity;"]
    assert value(X.unescape_html, *texts) == [html.unescape(t) for t in texts]


def test_nfkd_and_marks(value):
    assert value(X.normalize_unicode, "ﬁn*e* `é`") == "fine é"


def test_placeholders_collapse(value):
    assert value(X.collapse_placeholders, "[ID] [ID]  [ID] [URL] [URL] x [ID]") == "[ID] [URL] x [ID]"


def test_scoring_text(value):
    assert value(X.prepare_for_scoring, "  Mail A@B.com \n NOW ") == "mail [email] now"


@pytest.mark.parametrize("pattern", sorted(K.NEEDS))
def test_needs_never_hide_a_match(spark, pattern):
    """Texts glued from fragments: the guarded replacement equals the plain one."""
    rng = random.Random(7)
    parts = ["a@b.co", "@", "http", "https://x", "www.z", "account id: 1234", "12345678", "1234", "555-123-4567", "(555) 123 4567", "**", "*", "<b>", "<",
             "----", "---", "\n", " ", "This task was submitted through", "———", "─", "Best Regards,", "thank you in advance.", "[Insert x]",
             "[", "078-05-1120", "4111 1111 1111 1111", "١٢٣٤"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    flags = "is" if "submitted" in pattern or "regards" in pattern else "im"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", f"(?Ud{flags}u){pattern}", "#")
    bad = df.filter(X._sub(F.col("t"), pattern, "#", flags + "u") != plain)
    assert bad.count() == 0


def test_bands(spark):
    df = spark.createDataFrame([(0.95,), (0.9,), (0.7,), (0.5,), (0.1,)], "p double")
    assert [r.b for r in df.select(C.confidence_bucket(F.col("p")).alias("b")).collect()] == ["0.90-1.00", "0.90-1.00", "0.70-0.90", "0.50-0.70", "0.00-0.50"]
    sizes = spark.createDataFrame([(15.0,), (15.1,), (7.0,), (3.0,)], "p double")
    assert [r.b for r in sizes.select(C.topic_size_band(F.col("p")).alias("b")).collect()] == ["major", "largest", "regular", "specialist"]


RULES = [("First", "P1", [["~red apple"], ["=pear", "=plum"]]), ("Second", "P2", [["=plum"]])]


def test_rules_name_topics(spark):
    from tasksieve.operators.topics import classify_passport, suggest_name

    rows = [(1, ["pear", "Plum", "x"]), (2, ["plum", "y"]), (3, ["zzz"]), (4, ["red apple", "x"])]
    keywords = spark.createDataFrame(rows, "topic_id bigint, words array<string>")
    platforms = spark.createDataFrame([(2, "Rewh", 0.7)], "topic_id bigint, dominant string, dominant_share double")
    named = {r.topic_id: r.suggested_name for r in suggest_name(keywords, RULES, platforms, ["Second"]).collect()}
    assert named == {1: "First", 2: "Second (Rewh)", 3: "Topic_3", 4: "First"}
    assert [r.suggested_name for r in suggest_name(keywords, []).orderBy("topic_id").collect()][0] == "Topic_1"
    draft = spark.createDataFrame(
        [(i, ", ".join(w), "OK", 0.5, False, 0.0, "") for i, w in rows],
        "topic_id bigint, current_label string, confidence string, coherence double, split_recommended boolean, split_silhouette double, merge_with string")
    got = {r.topic_id: (r.business_name, r.business_pillar) for r in classify_passport(draft, RULES).collect()}
    assert got == {1: ("First", "P1"), 2: ("Second", "P2"), 3: ("Unclassified (Topic 3)", "Uncategorized"), 4: ("First", "P1")}
    assert {r.business_pillar for r in classify_passport(draft, []).collect()} == {"Uncategorized"}


def test_digits_are_looked_for_once(spark):
    """Masks that all need four digits in a row share one look at the text."""
    from tasksieve.functions.text import extract_field, mask_structural

    df = spark.createDataFrame([("id 12345 and 123456789, 123 456 7890",), ("no 123",), (None,)], "t string")
    out = df.select(mask_structural(F.col("t")).alias("m"), extract_field(F.col("t"), "Please specify.:").alias("f"))
    assert [tuple(r) for r in out.collect()] == [("[ID] and [ID] , [PHONE]", ""), ("no 123", ""), (None, None)]
    plan = df.select(mask_structural(F.col("t")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(K.FOUR_DIGITS) == 4  # for all of them, and again for each only in texts that have some
