"""URL filters against plain Python and against the SQL twin."""

import re

import duckdb
import pytest

from tasksieve.llm.queries import ORACLE, QUERIES, URL_RULES
from tasksieve.llm.urls import judge_pages

SCHEMA = "page_id bigint, url string, html string"


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_for(url, rules):
    host, path = cut(url)
    fits = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "allow"), default=None)


def plain(pages, links, rules):
    """pages: (id, url), links between full urls -> {id: (host, path, rule, verdict)}."""
    def node(u):
        scheme, rest = u.split("#")[0].split("://", 1)
        host = cut(u)[0]
        return scheme.lower() + "://" + host + rest[len(host):]

    around = {}
    for a, b in links:
        around.setdefault(node(a), set()).add(node(b))
        around.setdefault(node(b), set()).add(node(a))
    out = []
    for i, url in pages:
        own = rule_for(url, rules)
        verdict = own[2] if own else "allow"
        if not own and url and "://" in url:
            seen, todo = {node(url)}, [node(url)]
            while todo:
                for n in around.get(todo.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            told = {r[2] for r in (rule_for(n, rules) for n in seen) if r}
            verdict = "allow" if "allow" in told or not told else "block"
        out.append((i, *cut(url), own[0] + own[1] if own else None, verdict))
    return sorted(out, key=str)


def canonical(href):
    return f"<html><head><link rel='canonical' href=\"{href}\"></head><body>text</body></html>"


PAGES = [
    (1, "https://Blog.Example.NET/fr/1", None), (2, "http://example.net/en/2", ""), (3, "http://x.example.com/de/3?a#b", "<p>"),
    (4, "http://a.example.org/fr/4", None), (5, "http://example.net", None), (6, "http://net/", None), (7, "http://planet/", None),
    (8, None, canonical("http://b.net/")), (9, "no url", canonical("http://b.net/")), (10, "", None), (None, "http://b.net/", None),
    # aliases of a blocked page: by canonical, by refresh, by a chain and by a shared target that is no page
    (11, "http://free.io/a", canonical("http://b.net/z")), (12, "http://free.io/b", "<META http-equiv=Refresh content='0; URL=http://free.io/a'>"),
    (13, "http://free.io/c#part", canonical("/b")), (14, "http://free.io/d/e?q=1", canonical("../b")), (15, "http://free.io/f", canonical("c?x=1&amp;y=2")),
    (16, "http://free.io/c?x=1&y=2", canonical("//FREE.io/c")),
    # an allowed member goes before the blocked one
    (17, "http://mix.io/1", canonical("http://c.net/x")), (18, "http://mix.io/2", canonical("http://mix.io/1")), (19, "http://mix.io/3", canonical("http://example.net/en/9")),
    (20, "http://mix.io/1", canonical("http://mix.io/3")),
    # links that don't count
    (21, "http://no.io/1", "<!-- " + canonical("http://b.net/z") + " -->"), (22, "http://no.io/2", "<script>var x = '<link rel=\"canonical\" href=\"http://b.net/z\">'</script>"),
    (23, "http://no.io/3", "<link rel='stylesheet' href='http://b.net/z'> canonical"), (24, "http://no.io/4", canonical("#top") + canonical("") + canonical("mailto:x@b.net")),
    (25, "http://no.io/5", "x" * 300_000 + canonical("http://b.net/z")), (11, "http://free.io/a", canonical("http://b.net/z")),
]
LINKS = [("http://free.io/a", "http://b.net/z"), ("http://free.io/b", "http://free.io/a"), ("http://free.io/c", "http://free.io/b"), ("http://free.io/d/e?q=1", "http://free.io/d/../b"),
         ("http://free.io/f", "http://free.io/c?x=1&y=2"), ("http://free.io/c?x=1&y=2", "http://free.io/c"), ("http://mix.io/1", "http://c.net/x"), ("http://mix.io/2", "http://mix.io/1"),
         ("http://mix.io/3", "http://example.net/en/9"), ("http://mix.io/1", "http://mix.io/3"), ("http://no.io/5", "http://b.net/z")]


def collected(df):
    return sorted((tuple(r) for r in df.select("key", "host", "path", "rule", "verdict").collect()), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA)


@pytest.mark.parametrize("literal", [64, 0])
def test_aliases(spark, pages, monkeypatch, literal):
    from tasksieve.llm import urls

    monkeypatch.setattr(urls, "LITERAL_RULES", literal)  # both ways of finding rules
    got = collected(judge_pages(pages.withColumn("host", pages.url).withColumn("verdict", pages.url), URL_RULES))
    assert got == plain([p[:2] for p in PAGES], LINKS, URL_RULES)
    verdicts = {r[0]: r[4] for r in got}
    assert all(verdicts[k] == "block" for k in (11, 12, 13, 15, 16, 25)) and all(verdicts[k] == "allow" for k in (14, 17, 18, 19, 21, 22, 23, 24))


def test_sql_twin_on_linked_pages(spark, tmp_path):
    spark.createDataFrame(PAGES, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op11_redirect_rules"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    told = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE['op11_redirect_rules']})").fetchall()
    assert sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == sorted(told, key=str)


def test_redirect_table_long_chain_and_hub(spark):
    chain = [(f"http://r.io/{k}", f"http://r.io/{k + 1}") for k in range(40)] + [(f"http://hub.io/{k}", "http://bad.net/") for k in range(300)]
    urls = sorted({u for pair in chain for u in pair}) + ["http://r.io/40#x", "http://else.io/"]
    links = chain + [("http://r.io/40", "http://evil.net/x")]
    redirects = spark.createDataFrame([*links, (None, "http://r.io/1"), ("odd", "http://r.io/1")], "from_url string, to_url string")
    rows = list(enumerate(urls))
    got = collected(judge_pages(spark.createDataFrame(rows, "page_id bigint, url string"), URL_RULES, redirects, html=None))
    assert got == plain(rows, links, URL_RULES)
    assert sum(r[4] == "block" for r in got) == len(urls) - 1


def test_many_rules_join(spark):
    rules = [("net", "/", "block"), ("a.net", "/x", "allow"), ("a.net", "/", "block"), ("net", "/xyz", "allow"), ("net", "/xyz", "block"), ("b.a.net", "", "allow")]
    rules += [(f"h{k}.org", "/p" * (k % 5), "block" if k % 2 else "allow") for k in range(90)]
    urls = ["http://a.net/xyz", "http://b.a.net/xyz", "http://b.a.net", "http://c.net/xyzz", "http://c.net", "http://.net/", "http:///x"]
    urls += [f"http://{w}h{k}.org/p/p/p" for k in range(0, 90, 7) for w in ("", "www.", "x")]
    rows = list(enumerate(urls))
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    want = plain(rows, [], rules)
    assert collected(judge_pages(df, rules, html=None)) == want
    assert collected(judge_pages(df, spark.createDataFrame(rules, "host string, path string, verdict string"), html=None)) == want


def test_empty_and_native(spark, pages):
    assert collected(judge_pages(pages.limit(0), URL_RULES)) == []
    assert [r[3:] for r in collected(judge_pages(pages.filter("page_id = 6"), []))] == [(None, "allow")]
    plan = judge_pages(pages, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
