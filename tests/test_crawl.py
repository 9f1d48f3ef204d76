"""robots.txt against the standard library's parser, sitemaps, files by slug, and pages that nest badly."""

import json
import os
import random
import time
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from amberline.operators import retrieval, routing
from amberline.sources import crawl, html, tables

PATHS = ["/", "", "/a", "/a/", "/a/b", "/a%2Fb", "/%61", "/a b", "/a?", "/a?q=1", "/a?q=1#", "/a;", "/a;p", "/café", "/caf%C3%A9", "/100%", "/a+b", "*", "/*", "/b/c.html", "/a/b?x;", "/%zz"]
AGENTS = ["*", "amber", "Amberline", "amberline/2.0", "other", "line", "x, amber", "%2A", "b%6Ft"]


def robots_file(rng):
    def line():
        kind = rng.choice(["agent"] * 3 + ["rule"] * 6 + ["blank", "comment", "delay", "rate", "noise", "sitemap"])
        agent = rng.choice(["User-agent", "user-agent", "USER-AGENT", " User-Agent "])
        return {
            "agent": f"{agent}:{rng.choice(['', ' '])}{rng.choice(AGENTS)}", "rule": f"{rng.choice(['Disallow', 'Allow', 'disallow ', 'ALLOW'])}: {rng.choice(PATHS)}{rng.choice(['', '', ' # why', '  '])}",
            "blank": rng.choice(["", "", "  "]), "comment": "# nothing", "delay": f"Crawl-delay: {rng.choice(['3', 'x'])}", "rate": "Request-rate: 1/5", "noise": rng.choice(["Disallow", "Host: x.org", ":"]), "sitemap": "Sitemap: https://x.org/s.xml",
        }[kind]

    return rng.choice(["\n", "\r\n"]).join(line() for _ in range(rng.randint(0, 14))) + rng.choice(["", "\n"])


def test_robots_against_the_standard_library(spark):
    rng = random.Random(5)
    files = {f"h{k}.org": robots_file(rng) for k in range(500)}
    urls = sorted({(f"{rng.choice(['http', 'https'])}://{site}{rng.choice(PATHS[:17] + PATHS[19:])}") for site in files for _ in range(8)})
    df = spark.createDataFrame([(s, 200, b) for s, b in files.items()], "site string, status int, body string")
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    want = {}
    for u in urls:
        parser = RobotFileParser()
        parser.parse(files[u.split("/")[2].split("*")[0].split("?")[0]].splitlines())
        want[u] = parser.can_fetch("Amberline-bot/1.0", u)
    got = {r["url"]: r["allowed"] for r in crawl.robots_allowed(pages, crawl.robots_rules(df, "Amberline-bot/1.0")).collect()}
    assert 0.1 < sum(want.values()) / len(want) < 0.95
    assert [u for u in urls if got[u] != want[u]] == []


def test_unreadable_robots_stop_the_crawl(spark):
    df = spark.createDataFrame([("a.org", 200, "User-agent: *\nDisallow: /"), ("b.org", 503, "")], "site string, status int, body string")
    with pytest.raises(Exception, match="b.org returned HTTP 503"):
        crawl.robots_rules(df, "x").collect()
    rules = crawl.robots_rules(df.where("status = 200"), "x")
    pages = spark.createDataFrame([("https://a.org/x",), ("https://a.org/x",), ("https://c.org/",), (None,)], "url string")
    assert [r["allowed"] for r in crawl.robots_allowed(pages, rules).orderBy(F.desc_nulls_last("url")).collect()] == [True, False, False, True]


def test_sitemaps_that_list_each_other(spark):
    site = lambda *locs: "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<url><loc> {x}\n</loc></url>" for x in locs) + "</urlset>"
    many = lambda *locs: "<a:sitemapindex xmlns:a='u'>" + "".join(f"<a:sitemap><a:loc><![CDATA[{x}]]></a:loc><a:lastmod>2026</a:lastmod></a:sitemap>" for x in locs) + "</a:sitemapindex>"
    files = [("root", many("b", "sub", "gone")), ("sub", many("root", "a", "sub")), ("a", site("https://x.org/1?p=1&amp;q=2", "https://x.org/2")), ("b", site("https://x.org/2", "https://y.org/3", "https://x.org/no/4")), ("unused", site("https://x.org/9")), ("empty", site())]
    df = spark.createDataFrame(files, "location string, body string")
    urls = crawl.sitemap_urls(df, "root")
    found = tables.discovered(urls, "url", "place", "x.org", ("/no/",)).orderBy("place").collect()
    assert [r["url"] for r in found] == ["https://x.org/2", "https://x.org/1?p=1&q=2"]
    assert crawl.sitemap_urls(df, "nowhere").count() == 0 and crawl.sitemap_urls(df, "a").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        crawl.sitemap_urls(spark.createDataFrame([("root", "<urlset><url>")], "location string, body string"), "root").collect()


PAGE_ROWS = [("https://x.org/", "T", 200, "t", 2, "s", [("heading", "h"), ("text", "a\né\"")]), ("https://x.org/a/b?c=1", None, None, "t", 0, "s", []), ("https://x.org/..", "dots", 1, None, 1, "s", None)]


def test_files_by_slug(spark, tmp_path):
    df = spark.createDataFrame(PAGE_ROWS, tables.PAGE)
    path = str(tmp_path / "pages")
    crawl.write_corpus(df, path)
    assert sorted(os.listdir(path)) == ["-...json", "a_b_c_1.json", "index.json"] and os.listdir(tmp_path) == ["pages"]
    assert list(json.loads((tmp_path / "pages" / "index.json").read_text())) == df.columns
    read = tables.read_pages(spark, path).drop("path")
    assert read.exceptAll(df).count() == df.exceptAll(read).count() == 0
    crawl.write_corpus(df.limit(1), path)  # in the place of what was there
    assert len(os.listdir(path)) == 1
    with pytest.raises(Exception, match="FileExistsError"):
        crawl.write_corpus(df, path, overwrite=False)
    clash = df.union(df.where("title = 'T'").withColumn("url", F.lit("http://y.org/index")))
    with pytest.raises(ValueError, match="index"):
        crawl.write_corpus(clash, path)
    with pytest.raises(Exception, match="no such page"):
        crawl.write_corpus(df.withColumn("title", F.when(F.col("title").isNull(), F.raise_error(F.lit("no such page"))).otherwise(F.col("title"))), path)
    assert len(os.listdir(path)) == 1 and os.listdir(tmp_path) == ["pages"]


@pytest.mark.parametrize("page", ["<b>x</b>" * 8000, "<b>x" * 8000, "<p><b>x</b></p>" * 8000, "<h2>x" * 4000 + "</h2>" * 4000, "<div>" * 20000 + "x"])
def test_parsing_is_linear(page):
    began = time.perf_counter()
    html.blocks(f"<body>{page}</body>", "u")
    assert time.perf_counter() - began < 2


def test_labels_are_bold_runs_alone_in_their_parent():
    page = "<main><p><b>One label</b></p><p><b>not</b> alone</p><p><b></b><strong>Two</strong> </p><p><b>" + "w " * 13 + "</b></p><h3><b>in a heading</b> x</h3><p><b><i>nested</i></b></p></main>"
    assert [(b["kind"], b["text"][:12]) for b in html.blocks(page, "u")[1]] == [("heading", "One label"), ("text", "not"), ("text", "alone"), ("heading", "Two"), ("text", "w w w w w w "), ("heading", "in a heading"), ("heading", "nested")]


def test_pages_are_parsed_in_slices(spark, monkeypatch):
    monkeypatch.setattr(html, "SLICE", 40)
    rows = [(k, f"<title>t{k}</title><body>x{k}</body>" if k % 5 else None, "u") for k in range(50)]
    got = html.extracted(spark.createDataFrame(rows, "k int, html string, url string")).collect()
    assert {r["k"]: r["title"] for r in got} == {k: f"t{k}" if k % 5 else "u" for k in range(50)}


def test_the_fallback_contact_is_never_cited(spark):
    pages = lambda *names: retrieval.build(retrieval.corpus(spark.createDataFrame([(k, f"https://x.org/{n}", n, f"{n} words about research") for k, n in enumerate(names)], "k int, url string, title string, text string"), "k", "url", "title", "text"))
    asked = spark.createDataFrame([(1, "What dose is right?"), (2, "best pizza recipe")], "query_id long, query string")
    run = lambda index: {r["kind"]: ([c["url"] for c in r["citations"]], r["text"]) for r in routing.answers(index, asked).collect()}
    none = run(pages("mission", "events"))
    assert none["refusal"][0] == none["escalation"][0] == [] and routing.Contacts().url in none["escalation"][1]
    some = run(pages("mission", "contact"))
    assert some["refusal"][0] == some["escalation"][0] == ["https://x.org/contact"]
    both = run(pages("contact", "care-network"))
    assert both["refusal"][0] == ["https://x.org/care-network", "https://x.org/contact"] and both["escalation"][0] == ["https://x.org/contact"]
