"""URL filters: host and path rules, spread over redirects and canonical links by connected components.

Everything is made of DataFrame functions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasksieve.llm.common import broadcast_if_small, components
from tasksieve.session import checkpointed

#: A list of up to so many rules is a chain of conditions on each row; a longer one or a table of rules is joined, with the same result.
LITERAL_RULES = 64
#: Bytes of a row (host, path, rule) when a table of them is considered for a broadcast; longer urls are counted by ``_bytes``.
ROW_BYTES = 64

QUOTED = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
CANONICAL = r"""(?is)\srel\s*=\s*(?:canonical[\s/>]|"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?')"""
REFRESH = r"""(?is)\shttp-equiv\s*=\s*["']?refresh\b"""


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def with_url_parts(df: DataFrame, url: str) -> DataFrame:
    """``df`` with ``scheme``, ``host``, ``path`` and ``node`` (the url without its fragment, scheme and host in lower case) of the column ``url``.

    The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the path
    goes on up to ``?``, ``#`` or the end.  A null url, or one without ``://``, has empty host and path and a null scheme and node.
    One column follows from the other, so that the pattern of each is applied once a row.
    """
    c = F.col(f"`{url}`")
    at = F.coalesce(F.locate("://", c), F.lit(0))
    cut = df.withColumns({"scheme": F.when(at > 0, ascii_lower(F.substring(c, F.lit(1), at - 1))),
                          "__rest": F.when(at > 0, F.substring(c, at + 3, F.length(c))).otherwise("")})
    cut = cut.withColumn("__raw", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    cut = cut.withColumns({"host": ascii_lower(F.col("__raw")), "__tail": F.expr("substring(__rest, length(__raw) + 1)")})
    cut = cut.withColumns({"path": F.regexp_extract("__tail", r"^[^?#]*", 0),
                           "node": F.concat("scheme", F.lit("://"), "host", F.regexp_extract("__tail", r"^[^#]*", 0))})
    return cut.drop("__rest", "__raw", "__tail")


def _value(tag: Column, name: str) -> Column:
    """The value of an attribute, without its quotes."""
    found = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{QUOTED}", 1)
    return F.trim(F.replace(F.regexp_replace(found, r"""^["']|["']$""", ""), F.lit("&amp;"), F.lit("&")))


def link_targets(html: Column) -> Column:
    """What a page's canonical links and refresh tags point to, as written; tags in comments, scripts and styles don't count."""
    shown = F.regexp_replace(html, HIDDEN, " ")
    canonical = F.transform(F.filter(F.regexp_extract_all(shown, F.lit(LINK), F.lit(0)), lambda t: t.rlike(CANONICAL)), lambda t: _value(t, "href"))
    moved = F.transform(F.filter(F.regexp_extract_all(shown, F.lit(META), F.lit(0)), lambda t: t.rlike(REFRESH)),
                        lambda t: F.trim(F.regexp_replace(F.regexp_extract(_value(t, "content"), r"(?is);\s*url\s*=\s*(.*)$", 1), r"""^["']|["']$""", "")))
    return F.when(html.rlike(r"(?i)canonical|refresh"), F.concat(canonical, moved))


def resolved(target: Column, scheme: Column, host: Column, path: Column) -> Column:
    """A link as a full url; null for an empty one, a bare fragment and one of another kind (``mailto:``)."""
    site = F.concat(scheme, F.lit("://"), host)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"(?s)^.*/", 0))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when((target == "") | target.startswith("#"), None)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target.startswith("?"), F.concat(site, path, target))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
            .otherwise(F.concat(site, folder, target)))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(a, b)``: the links of equivalence that pages state themselves, as nodes of ``with_url_parts``."""
    cut = with_url_parts(pages.select(F.col(f"`{url}`").alias("url"), link_targets(F.col(f"`{html}`")).alias("targets")).filter("size(targets) > 0"), "url")
    each = cut.select("scheme", "host", "path", F.col("node").alias("a"), F.explode("targets").alias("target")).filter("a is not null")
    whole = each.select("a", resolved(F.col("target"), F.col("scheme"), F.col("host"), F.col("path")).alias("url"))
    return with_url_parts(whole, "url").select("a", F.col("node").alias("b")).filter("b is not null and a <> b")


def _chained(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """The rule of each row, tried from the longest."""
    chain = None
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r[2] != "allow")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, found) if chain is None else chain.when(fits, found)
    found = chain if chain is not None else F.lit(None).cast("struct<rule:string,verdict:string>")
    return rows.withColumn("found", found)


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of each row, by joins on the suffixes of hosts and the path lengths that rules of such a host have."""
    rules = rules.select(F.col("host").alias("rh"), F.col("path").alias("rp"), "verdict").groupBy("rh", "rp").agg(F.min("verdict").alias("verdict"))
    lengths = rules.groupBy("rh").agg(F.collect_set(F.length("rp")).alias("lengths"))
    targets = rows.select("host", "path").filter("host <> ''").distinct()
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ways = (targets.select("host").distinct().select("host", F.explode(suffixes).alias("rh")).join(lengths, "rh")
            .groupBy("host").agg(F.collect_list(F.struct("rh", "lengths")).alias("ways")))  # as many as a host has labels
    tried = targets.join(ways, "host").select("host", "path", F.explode("ways").alias("way")).select("host", "path", "way.rh", F.explode("way.lengths").alias("n"))
    hits = (tried.filter(F.length("path") >= F.col("n")).withColumn("rp", F.expr("left(path, n)")).join(rules, ["rh", "rp"])
            .groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), "verdict"),
                                                  F.struct(F.length("rh") + F.length("rp"), F.length("rh"))).alias("found")))
    return rows.join(hits, ["host", "path"], "left")


def with_rules(rows: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``rows`` (with host and path) and ``found``: rule and verdict of the longest rule that fits, else null.

    Rules are (host, path, verdict).  A rule fits its host and all subdomains if the path starts with the rule's.  The longest
    host and path together win, of equally long ones the longer host; a rule listed as both is an allow.
    """
    if isinstance(rules, list) and len(rules) > LITERAL_RULES:
        values = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules])
        rules = rows.sparkSession.range(1).select(F.inline(values))
    return _chained(rows, rules) if isinstance(rules, list) else _joined(rows, rules)


def alias_verdicts(links: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``(node, verdict)`` of every linked url whose class holds a decision: allow if any member is allowed by a rule, else block.

    ``links (a, b)`` are undirected; classes are their connected components, found by contraction, so a url that a third of
    all pages point to is aggregated and joined, never gathered.
    """
    members = components(links, "a", "b").select("node", "component")
    judged = with_rules(with_url_parts(members.withColumnRenamed("node", "url"), "url").select("component", "host", "path"), rules)
    decided = (judged.groupBy("component").agg(F.bool_or(F.col("found.verdict") == "allow").alias("allows"), F.bool_or(F.col("found.verdict") == "block").alias("blocks"))
               .filter("allows or blocks").select("component", F.when(F.col("allows"), "allow").otherwise("block").alias("verdict")))
    return members.join(decided, "component").select("node", "verdict")


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None,
                id: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """One row per row of ``pages``: ``key``, ``host``, ``path``, ``rule``, ``verdict`` (allow or block).

    A page that a rule fits has that rule's verdict.  Any other page is judged by its equivalence class: urls are
    equivalent if connected by canonical links and refresh tags of ``html`` and by ``redirects (from_url, to_url)``, whether
    their targets are in ``pages`` or not.  A class with an allowed url is allowed (an explicit allow goes before a block that
    is only passed on), one with blocked urls and no allowed one is blocked.  All others are allowed.

    Null and empty urls, and those without ``://``, have empty host and path, no rule, no aliases, and are allowed.  Null html
    has no links.  Repeated rows each have a row; null ids stay null; an empty table gives an empty result; further columns
    aren't looked at.  Texts of any length are searched as a whole.  Links are written to the checkpoint folder once.
    """
    links = None
    if html is not None:
        links = page_links(pages, url, html)
    if redirects is not None:
        told = with_url_parts(redirects.select("from_url", "to_url"), "from_url").select(F.col("node").alias("a"), "to_url")
        told = with_url_parts(told, "to_url").select("a", F.col("node").alias("b")).filter("a is not null and b is not null")
        links = told if links is None else links.unionByName(told)
    own = pages.select(F.col(f"`{id}`").alias("key"), F.col(f"`{url}`").alias("url"))
    rows = with_rules(with_url_parts(own, "url").select("key", "host", "path", "node"), rules)
    if links is not None:
        links = checkpointed(links.distinct())
    if links is None or links.isEmpty():
        passed = F.lit(None).cast("string")
    else:
        passed = F.col("passed")
        verdicts = checkpointed(alias_verdicts(links, rules).select(F.col("node").alias("alias"), F.col("verdict").alias("passed")))
        size = verdicts.agg(F.coalesce(F.sum(F.octet_length("alias")), F.lit(0))).first()[0]
        per_row = ROW_BYTES + size // max(1, verdicts.count())
        rows = rows.join(broadcast_if_small(verdicts, per_row), F.col("node") == F.col("alias"), "left")
    return rows.select("key", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", passed, F.lit("allow")).alias("verdict"))
