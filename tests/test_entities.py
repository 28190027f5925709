"""Entity extraction, removal, flags and platforms on invented names."""

import re

import pytest
from pyspark.sql import functions as F

from tasksieve.operators import entities as E
from tasksieve.operators import masking as M

DICTIONARY = [("Rewh", "platforms.portfolio"), ("Orre", "platforms.document"), ("Arco", "platforms.portfolio"), ("arco - east", "platforms.portfolio"),
              ("Gold Harbor", "banks"), ("Gold", "banks"), ("Tamsin Bank", "custodians")]
TRACKED = ["Rewh", "Orre", "Arco"]


@pytest.fixture(scope="module")
def run(spark):
    def process(text):
        df = spark.createDataFrame([("1", text)], "task_id string, text string")
        spans = E.extract_entities(F.col("text"), DICTIONARY, guarded=("arco",))
        marked = df.withColumn("s", spans)
        row = marked.select("s", E.remove_entities(F.col("text"), F.col("s")).alias("clean"), E.assign_platform(F.col("s"), TRACKED).alias("p")).first()
        log = [r.asDict() for r in E.anonymization_log(marked, "text", "s").collect()]
        return [x["entity"] for x in row.s], row.clean, row.p, log, row.s

    return process


def test_extract_and_remove(run):
    found, clean, platform, _, _ = run("Rewh is failing to sync with Orre regarding the Q1 report.")
    assert found == ["Rewh", "Orre"]
    assert "Rewh" not in clean and "Orre" not in clean and "Q1 report" in clean
    assert platform.primary_platform == "Rewh"


def test_right_guard(run):
    found, clean, platform, log, _ = run("The system arcology needs updating")
    assert found == [] and clean == "The system arcology needs updating" and log == []
    assert run("Update arco_2 view")[0] == ["arco"]


def test_plain_sentence(run):
    found, clean, platform, _, _ = run("  Nothing to see here  ")
    assert found == [] and clean == "Nothing to see here"
    assert platform.primary_platform == "General" and platform.secondary_platform is None


def test_two_platforms_in_order(run):
    platform = run("Sync Orre documents with Rewh views")[2]
    assert (platform.primary_platform, platform.secondary_platform) == ("Orre", "Rewh")
    assert run("Rewh and again rewh")[2].secondary_platform == "Rewh"


def test_longest_match(run):
    assert run("Gold Harbor statement export")[0] == ["Gold Harbor"]
    assert run("A Gold statement")[0] == ["Gold"]


def test_variant_is_removed_whole_and_not_tracked(run):
    found, clean, platform, _, _ = run("Fix feed in arco - east for Q1")
    assert found == ["arco - east"] and "east" not in clean
    assert platform.primary_platform == "General"


def test_orphan_preposition(run):
    assert run("Upload documents to Orre")[1] == "Upload documents"
    assert run("Orre and reports")[1] == "reports"


def test_any_case(run):
    assert run("Update REWH views and check ORRE folder")[0] == ["REWH", "ORRE"]


def test_flags(run):
    _, _, _, log, _ = run("Error 505 in Rewh causing issues")
    assert {"numeric_adjacent", "trailing_preposition"} <= set(log[0]["flags"])
    assert all("adjacent_removal" in e["flags"] for e in run("Sync Rewh with Orre data")[3])
    assert "short_result" in run("Fix Rewh")[3][0]["flags"]


def test_spans_are_offsets(run):
    text = "Zürich: Rewh, Orre; Gold Harbor"
    for s in run(text)[4]:
        assert text[s.start:s.end] == s.entity


def test_context_follows_the_edits_from_right_to_left(run):
    text = "Please move the Rewh file into Orre and Gold now"
    log = run(text)[3]
    spans = [(e["span_start"], e["span_end"]) for e in log]
    edited, want = text, {}
    for start, end in reversed(spans):
        want[start] = edited[max(0, start - 10):min(len(edited), end + 10)]
        edited = edited[:start] + edited[end:]
    assert {e["span_start"]: e["context_window"] for e in log} == want


def test_log_joins_back(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(["Rewh down", "nothing", "Orre and Rewh"])], "task_id string, text string")
    marked = df.withColumn("s", E.extract_entities(F.col("text"), DICTIONARY))
    log = E.anonymization_log(marked, "text", "s")
    assert {r.task_id for r in log.collect()} == {"0", "2"}
    assert marked.select("task_id", E.remove_entities(F.col("text"), F.col("s")).alias("c")).count() == 3


@pytest.mark.parametrize("text", ["Tell Gold Harbor and gold", "gold,Gold Harbor!Golden", "no names", "", "Tamsin  Bank; tamsin bank", "éGold Gold"])
def test_both_masking_ways_agree(spark, text):
    rules = spark.createDataFrame([(n, f"[{c.upper()[:4]}]") for n, c in DICTIONARY], "variant string, placeholder string")
    df = spark.createDataFrame([("1", text), ("2", "x " + text + " y")], "task_id string, text string")
    by_regex = {r.task_id: r.text for r in M.mask_dictionary(df, "text", rules, strategy="regex").collect()}
    by_join = {r.task_id: r.text for r in M.mask_dictionary(df, "text", rules, strategy="join").collect()}
    assert by_regex == by_join


def test_masking_loses_nothing(spark):
    """Terms that begin with punctuation, and letters that equal others only without case."""
    rules = spark.createDataFrame([("smith", "[A]"), ("(K1) fund", "[B]"), ("& co.", "[C]"), ("kelvin", "[D]"), ("istanbul", "[E]"), ("straße", "[F]")],
                                  "variant string, placeholder string")
    text = "ſmith went home with smith & co. for the (k1) FUND of \u212aelvin in İstanbul, STRAßE today"
    want = "[A] went home with [A] [C] for the [B] of [D] in [E] , [F] today"
    df = spark.createDataFrame([("1", text)], "task_id string, text string")
    many = rules.unionByName(spark.createDataFrame([(f"zz{i}q", "[Z]") for i in range(M.REGEX_RULES)], "variant string, placeholder string"))
    for got in (M.mask_dictionary(df, "text", rules, strategy="regex"), M.mask_dictionary(df, "text", rules, strategy="join"), M.mask_dictionary(df, "text", many)):
        assert got.first().text == want
    spans = df.select(E.extract_entities(F.col("text"), [("smith", "people")]).alias("s")).first().s
    assert [x.category for x in spans] == ["people", "people"]


def test_masking_of_many_terms_that_begin_with_no_word_character(spark):
    rules = [("smith", "[A]"), ("(K1) fund", "[B]"), ("(K1", "[X]"), ("& co.", "[C]"), ("\u212aelvin", "[D]"), ("#7", "[E]"), ("co. for", "[Y]")]
    many = rules + [(f"#zz{i}q", "[Z]") for i in range(M.REGEX_RULES + 1)]
    texts = ["smith & co. for the (k1) FUND, #7 and #77 a#7", "#ZZ5q#zz2000q  (k1 kelvin", "no term", "", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "task_id string, text string")
    schema = "variant string, placeholder string"
    got = {r.task_id: r.text for r in M.mask_dictionary(df, "text", spark.createDataFrame(many, schema)).collect()}
    few = spark.createDataFrame(rules + [("#zz5q", "[Z]"), ("#zz2000q", "[Z]")], schema)
    want = {r.task_id: r.text for r in M.mask_dictionary(df, "text", few, strategy="join").collect()}
    assert got == want and len(got) == len(texts) and got["0"].startswith("[A] [C] for the [B] , [E] and #77")


def test_log_context_beyond_many_touching_spans(spark):
    text = "abcdefghijklm tail text"
    spans = [(c, "x", i, i + 1) for i, c in enumerate(text[:13])]
    df = spark.createDataFrame([("1", text, spans)], "task_id string, text string, s array<struct<entity:string,category:string,start:int,end:int>>")
    rows = {r.span_start: r.context_window for r in E.anonymization_log(df, "text", "s").collect()}
    assert rows[0] == "a tail text" and rows[12] == "cdefghijklm"[:10] + "m tail text" or rows[0].startswith("a tail tex")


def test_overlapping_detections(spark):
    span = "array<struct<entity:string,category:string,start:int,end:int>>"
    df = spark.createDataFrame([([("a", "x", 0, 4), ("b", "x", 2, 9), ("c", "x", 0, 2), ("d", "x", 9, 11)],)], f"s {span}")
    assert [x.entity for x in df.select(E.resolve_overlaps(F.col("s")).alias("r")).first().r] == ["a", "d"]


def test_check_digit(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("4111 1111 1111 1112",)], "c string")
    assert [r.ok for r in df.select(M.luhn_ok(F.col("c")).alias("ok")).collect()] == [True, False]


def test_scan_masks_by_type(spark):
    df = spark.createDataFrame([("1", "Mail a.b@example.com or 212-555-0100, id 078-05-1120, card 4111111111111111.")], "task_id string, text string")
    masked, log = M.pii_scan(df, "text")
    assert masked.first().text == "Mail [EMAIL] or [PHONE], id [ID], card [CREDIT_CARD]."
    assert {r.entity_type for r in log.collect()} == {"EMAIL_ADDRESS", "PHONE_NUMBER", "US_SSN", "CREDIT_CARD"}
    assert M.pii_scan(df, "text", min_score=0.95)[1].count() == 2


def test_many_spans_give_what_few_do(spark):
    """Beyond a block of spans texts are taken apart into characters; results stay the same."""
    unit = "né Acme,Foo to 7 Acmé 💡 "
    entries = [("Acme", "org"), ("Foo", "org"), ("7", "number")]
    terms = re.compile(r"(?<!\w)(?:Acme|Foo|7)(?!\w)")
    for n in (1, 300):
        text = unit * n
        df = spark.createDataFrame([("1", text)], "task_id string, t string")
        df = df.withColumn("s", E.extract_entities(F.col("t"), entries))
        row = df.select("s", E.cut_spans(F.col("t"), F.col("s")).alias("cut")).first()
        spans = [m.span() for m in terms.finditer(text)]
        assert [(x.start, x.end) for x in row.s] == spans
        assert row.cut == terms.sub("", text)
        log = {r.span_start: r for r in E.anonymization_log(df, "t", "s").collect()}
        assert len(log) == len(spans)
        for start, end in spans:
            assert log[start].context_window == text[max(0, start - 10):end] + terms.sub("", text[end:])[:10]
            near = text[max(0, start - 5):start] + " " + text[end:end + 5]
            assert ("numeric_adjacent" in log[start].flags) == any(ch.isdigit() for ch in near)


def test_dictionary_join_equals_the_pattern(spark):
    terms = DICTIONARY + [("(K1) fund", "funds"), ("& co.", "suffix"), ("smith", "people"), ("K2", "codes"), ("Gold Harbor (K1)", "mixed")]
    texts = ["Sync Rewh with orre", "The arcology of Arco", "arco - east, arco-east, ARCO2", "Gold Harbor (K1) fund & Co. end", "ſmith & CO., smiths smith_1 smith",
             "K2 (k1) Fund x(K1) fund", "", "no name", "émile ä Gold\U0001f600Gold  gold", "Tamsin Bank" * 3, "x" * 5000 + " Rewh" * 700]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, None])], "task_id string, text string")
    want = {r.task_id: r.s for r in df.select("task_id", E.extract_entities(F.col("text"), terms, ("arco",)).alias("s")).collect() if r.s}
    dictionary = spark.createDataFrame(terms, "name string, category string")
    got = {r.task_id: r.spans for r in E.dictionary_spans(df, "text", dictionary, ("arco",)).collect()}
    assert got == want and len(got["10"]) == 700
    leaks = {(r.task_id, r.value) for r in E.dictionary_leaks(df, "text", dictionary).collect()}
    assert {v for i, v in leaks if i == "3"} == {"gold", "gold harbor", "gold harbor (k1)", "(k1) fund", "& co."}


def _random_terms(seed, n):
    """Terms that begin with punctuation, contain others, and share their beginnings."""
    import random

    rng = random.Random(seed)
    parts = ["smith", "acme", "k1", "&", "(", ")", " ", " ", ".", "co", "é", "-", "_x", "7"]
    return sorted({"".join(rng.choice(parts) for _ in range(rng.randint(1, 6))).strip() for _ in range(n)} - {""})


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_the_pattern(spark, seed):
    """The walk finds what one pattern over all terms finds, whatever terms begin with and contain."""
    import random

    rng = random.Random(seed)
    terms = _random_terms(seed, 60)
    rules = spark.createDataFrame([(t, f"[{i % 5}]") for i, t in enumerate(terms)], "variant string, placeholder string")
    pool = [" ", " ", ".", "", *terms, *(t.upper() for t in terms), "other", "smiths", "(k1"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(14))) for i in range(150)] + [(None, terms[0]), (None, None), (3, "twin " + terms[1]), (3, "")]
    df = spark.createDataFrame(rows, "task_id bigint, text string")
    by_regex = sorted((tuple(r) for r in M.mask_dictionary(df, "text", rules, strategy="regex").collect()), key=str)
    by_join = sorted((tuple(r) for r in M.mask_dictionary(df, "text", rules, strategy="join").collect()), key=str)
    assert by_regex == by_join and any("[" in (r[1] or "") for r in by_regex)


@pytest.mark.parametrize("extra", [2_001, 200_000])
def test_many_rules_mean_what_few_do(spark, extra):
    """A client's name must not stay because a shorter term inside it was masked first."""
    rules = spark.createDataFrame([("& co", "[B]"), ("smith & co", "[CLIENT]"), ("(k1) fund", "[B]"), ("acme (k1) fund", "[CLIENT]"), ("the", None)], "variant string, placeholder string")
    many = rules.unionByName(spark.range(extra).selectExpr("concat('the ', id, ' (', id % 7, ')') AS variant", "'[T]' AS placeholder"))
    texts = ["I met Smith & Co today", "the Acme (K1) fund fell", "x & co, (k1) fund; the 55 (6) and the 55 (5)", None]
    df = spark.createDataFrame(list(enumerate(texts)), "task_id bigint, text string")
    got = {r.task_id: r.text for r in M.mask_dictionary(df, "text", many).collect()}
    assert got[0] == "I met [CLIENT] today" and got[1] == "[MASKED] [CLIENT] fell" and got[3] is None
    assert got[2] == "x [B] , [B] ; [T] and [MASKED] 55 (5)"


def test_trie_walk_ends_early(spark):
    """Beginnings that many terms share are one row a place, not one a term."""
    dictionary = spark.range(3_000).selectExpr("concat('big bank of ', id) AS name", "'x' AS category")
    df = spark.createDataFrame([("1", "big bank of 7 and the big bank of 2999, big bank of 3000 big bank")], "task_id string, text string")
    trie = E.term_trie(dictionary)
    assert trie.filter("depth < 6").count() == 6 and trie.count() == 6 + 3_000
    assert sorted((r.entity, r.start) for r in E.dictionary_hits(df, "text", dictionary).collect()) == [("big bank of 2999", 22), ("big bank of 7", 0)]
    assert E.dictionary_hits(df, "text", dictionary.limit(0)).count() == 0


def test_only_places_of_first_tokens_become_rows(spark):
    """A text of many words is one row a place where a term may begin, whichever way the places are found."""
    text = "word " * 500 + "Gold Bank, golden gold&co \u03a3 xgold GOLD"
    df = spark.createDataFrame([("1", text), ("2", None), ("3", "")], "task_id string, text string")
    want = [(i, text[i:i + 4]) for i in range(len(text)) if text[i:i + 4].lower() == "gold" and not text[i - 1].isalnum() and not text[i + 4:i + 5].isalnum()]
    for first in (["gold"], ["gold", *(f"z{i}" for i in range(E.PATTERN_TOKENS))]):
        rows = sorted((r.start, r.ahead[0], len(r.ahead)) for r in E.term_places(df, "text", first, 3, "task_id").collect())
        assert [r[:2] for r in rows] == want and [r[2] for r in rows] == [3, 3, 1]


def test_gaps_and_matches_from_one_search(spark):
    """The pattern is searched for once, with the same pieces as two searches, marks and empty matches in the text included."""
    from tasksieve.operators.entities import MARK, pieces

    texts = ["", "Orre and ſtar", "orreorre orre", f"a{MARK}b orre {MARK}", "orre", "no", None, "Kit İnn star", "x orre\nstar orre"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = r"(?iu)(?<![\p{L}\p{N}_])(?:star(?![\p{L}\p{N}_])|orre(?![\p{L}\p{N}_])|kit(?![\p{L}\p{N}_])|inn(?![\p{L}\p{N}_]))"
    for pattern, same in ((M.alternation(["orre", "star", "kit", "inn"]), plain), ("o*", "o*"), ("", "")):
        got = df.select(pieces(F.col("t"), pattern, lambda g, h: F.struct(g.alias("g"), h.alias("h"))).alias("x"),
                        F.split("t", same, -1).alias("g"), F.regexp_extract_all("t", F.lit(same), F.lit(0)).alias("h"))
        for r in got.collect():
            assert (r.x.g, r.x.h) == (r.g, r.h)
    one = df.select(pieces(F.col("t"), "orre", lambda g, h: F.size(g)))._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" in one
