import json

import pytest
from pyspark.sql import functions as F

from loomspan.functions import guards as G
from loomspan.functions import text as T
from loomspan.functions import urls as U
from loomspan.operators import crawl, dom, evaluation, links, robots, scrape, search, store
from loomspan.sources import responses


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_normalize_url(spark):
    cases = {
        "HTTP://User@Ex.COM:80/Path//": "http://user@ex.com:80/Path",
        "https://a.b/x?b=2&a=1&&a=0": "https://a.b/x?a=0&a=1&b=2",
        "https://a.b/?utm_source=x&ref=1&q=": "https://a.b?q=",
        "https://a.b/p?fbclid=1&gclid=2#frag": "https://a.b/p",
        "https://a.b/p?q=a+b%20c%2F&z=%zz": "https://a.b/p?q=a+b+c%2F&z=%25zz",
        "mailto:x@y": "mailto:x@y",
        "https://a.b": "https://a.b",
        "/rel/": "/rel",
        "": "",
        None: None,
    }
    assert column(spark, list(cases), U.normalize_url) == list(cases.values())


def test_url_hash_is_stable_over_variants(spark):
    a, b = column(spark, ["https://A.b/x/?utm_a=1", "https://a.B/x#t"], U.url_hash)
    assert a == b and len(a) == 32


def test_resolve(spark):
    base = F.lit("http://a/b/c/d;p?q")
    cases = {
        "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
        "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../../g": "http://a/g", "../../../g": "http://a/g", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "http://z/../y": "http://z/../y",
    }
    assert column(spark, list(cases), lambda v: U.resolve(base, v)) == list(cases.values())


@pytest.mark.parametrize("pattern,yes,no", [("/docs/*", ["/docs/", "/docs/a/b"], ["/doc", "/x/docs/a"]), ("*.p?f", ["a.pdf"], ["a.pf"]), ("/[!ab]x", ["/cx"], ["/ax"]), ("/a+b(", ["/a+b("], ["/aab("])])
def test_glob(spark, pattern, yes, no):
    assert column(spark, yes + no, lambda v: U.glob_match(v, pattern)) == [True] * len(yes) + [False] * len(no)


def test_visible_text_and_entities(spark):
    html = ["<p>a&amp;lt; b</p><SCRIPT>x</script><style>\n</style>c", "x &eacute;&#233; &amp", "<script>never closed", None, "a&nbsp;b"]
    assert column(spark, html, T.visible_text) == ["a&lt; b c", "x éé &", "never closed", "", "a b"]


def test_truncate_cases(spark):
    rows = column(spark, ["abc\ndef\nghi", "abcdef", "\nabcdef", "abc\n", "abcd\nx"], lambda v: T.truncate(v, 4))
    assert [tuple(r) for r in rows] == [("abc\n", True), ("abcd", True), ("\nabc", True), ("abc\n", False), ("abcd\n", True)]


def test_figures_and_slugs(spark):
    assert column(spark, ["$47, $9.5 €1,200.50 £x"], T.figures) == [["$47,", "$9", "€1,200.50"]]
    assert column(spark, ["It's “Ünder” a TEST", "", "a" * 70, ("word-" * 20)], T.slugify) == ["its-nder-a-test", "untitled", "a" * 60, "-".join(["word"] * 12)]


def test_guards_at_their_limits(spark):
    cluster = lambda gap: "$1" + "x" * gap + "$2" + "x" * gap + "$3" + "x" * gap + "$4"
    assert column(spark, [cluster(498), cluster(499), "$1 $1 $2 $3", "$1 $2 $3 $4"], G.has_price_cluster) == [True, False, False, True]
    body = "are you a robot" + "x" * (30_000 - 15)
    assert column(spark, [body, body + "x", "", None], G.looks_blocked) == [True, False, False, False]
    assert column(spark, ["a\na\na\nb\nb\nb", "a\na\na\nb\nb", "a\r\na\ra\n\n b\nb \nb"], G.has_collapsed_columns) == [True, False, True]


ARTICLE = """<html><head><title>Real title | Site</title><meta name="description" content="About it"></head><body><nav><a href="/n">Nav $9</a></nav>
<main><article><h1>Real title</h1><p>First <strong>bold <em>and</em></strong> words with a <a href="/link">link</a>.</p><h2>Part</h2><ul><li>one<li>two</ul>
<pre>x = 1\n  y = 2</pre><table><tr><th>Plan</th><th>Price</th></tr><tr><td colspan=2>Basic $5</td></tr></table><aside>Promo</aside></article></main><footer>Foot</footer></body></html>"""


def test_main_content():
    p = dom.parse(ARTICLE)
    assert p["title"] == "Real title" and p["description"] == "About it"
    md = p["markdown"]
    for part in ("# Real title", "First bold and words with a link.", "## Part", "- one", "- two", "x = 1\n  y = 2", "| Plan | Price |", "| Basic $5 |"):
        assert part in md
    for chrome in ("Nav", "Promo", "Foot", "/link"):
        assert chrome not in md
    assert "[link](/link)" in dom.parse(ARTICLE, include_links=True)["markdown"]
    assert dom.parse("")["markdown"] is None and dom.parse(b"\x00\xff\xfe")["markdown"] in (None, "\x00��")
    prose = "words " * 30
    page = f"<div><a href=/a>Home</a> <a href=/b>All</a></div><div>{prose}</div><div><a href=/c>next page link</a></div>"
    assert dom.parse(page)["markdown"] == prose.strip()


def test_charsets():
    assert "日本" in dom.decode("<meta charset=shift_jis>日本".encode("shift_jis"))
    assert dom.decode("﻿é".encode()) == "é" and dom.decode("<meta charset='latin-1'>é".encode("latin-1")).endswith("é")
    assert dom.decode(b"\xff<meta charset=nonsense>") == "�<meta charset=nonsense>"


def test_tables_structured_and_links(spark):
    nested = "<table><caption> C </caption><tr><th>a <b>b</b></th></tr><tr><td>1</td></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table><table></table>"
    t = dom.parse(nested, max_rows=2)["tables"]
    assert t[0]["caption"] == "C" and t[0]["headers"] == ["a", "b"] and t[0]["rows"] == [["1"], ["in"]] and t[0]["truncated"] and t[1]["rows"] == [["in"]]
    micro = json.loads(dom.parse("<div itemscope itemtype=T><i itemprop=n>N</i><div itemprop=o itemscope><i itemprop=p>P</i></div></div>")["microdata"])
    assert micro == [{"type": "T", "properties": {"n": "N", "o": {"properties": {"p": "P"}}}}]
    page = """<a href="/a">x</a><a class=k href='b?utm_x=1'>y</a><A HREF=/a/>z</A><!-- <a href="/no"> --><a href="mailto:x">m</a><a href="http://[bad/">b</a><a>n</a>"""
    df = spark.createDataFrame([(1, "https://h.x/d/", page)], "page_id int, url string, html string")
    got = [(r.pos, r.link) for r in links.extract_links(df).orderBy("pos").collect()]
    assert got[:2] == [(0, "https://h.x/a"), (1, "https://h.x/d/b")] and all("mailto" not in u for _, u in got)


def test_sitemaps():
    assert dom.sitemap("<urlset xmlns='x'><url><loc> a </loc></url></urlset>") == {"locs": ["a"], "is_index": False}
    bomb = "<!DOCTYPE l [<!ENTITY a 'ha'><!ENTITY b '&a;&a;'>]><urlset><loc>&b;</loc></urlset>"
    assert dom.sitemap(bomb) == dom.sitemap("<broken") == dom.sitemap(None) == {"locs": [], "is_index": False}


def test_robots_rules():
    body = "User-agent: a\nUser-agent: loomspan\nDisallow: /x\nAllow: /x/y$\nCrawl-delay: 99\n\nUser-agent: *\nDisallow: /\n"
    r = robots.rules(body, "Loomspan/2.0")
    assert [x["pattern"] for x in r["rules"]] == ["/x", "/x/y$"] and r["delay"] == 10.0
    assert [x["pattern"] for x in robots.rules(body, "other")["rules"]] == ["/"] and robots.rules(None, "a") == {"rules": [], "delay": None}


def replay(log):
    held = {}
    for w in sorted(log, key=lambda w: w["seq"]):
        old = held.get(w["url_hash"])
        if not w["force"] and old and old["via"] == "playwright" and w["via"] != "playwright":
            continue
        held[w["url_hash"]] = w
    return {k: w["seq"] for k, w in held.items()}


def test_upsert_equals_a_replay(spark):
    import random

    rng = random.Random(4)
    log = [{"url_hash": rng.randrange(60), "seq": i, "via": rng.choice(["httpx", "playwright"]), "force": rng.random() < 0.15} for i in range(900)]
    df = spark.createDataFrame(log, "url_hash int, seq int, via string, force boolean")
    assert {r.url_hash: r.seq for r in store.upsert(df).collect()} == replay(log)


def test_ttl_boundary_and_prune(spark):
    pages = spark.createDataFrame([("a", 100), ("b", 101)], "url_hash string, fetched_at long")
    got = store.ttl_read(pages.select("url_hash"), pages, ttl_seconds=50, now=150).collect()
    assert [r.url_hash for r in got] == ["b"]
    kept, _, removed = store.prune(pages, pages.limit(0), older_than_seconds=50, now=150)
    assert removed.first().removed == 1 and [r.url_hash for r in kept.collect()] == ["b"]


def test_bfs_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = {r.url: r.depth for r in crawl.bfs(edges, spark.createDataFrame([("a",)], "url string"), max_depth=2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_scrape_raw_mode_and_oversize(spark):
    rows = spark.createDataFrame([("https://a.b/1", 200, "text/html", "<p>x</p>", None), ("https://a.b/2", 200, "text/html", "<script></script>", None), ("https://a.b/3", 200, "text/html", "y" * 100, None)], "url string, status int, content_type string, html string, error string")
    out = scrape.outcomes(scrape.with_extraction(scrape.normalise_responses(rows, max_bytes=50)), raw=True).orderBy("url").collect()
    assert [r.outcome for r in out] == ["raw", "raw_empty", "fetch_error"] and out[0].body == "x"


def test_search_lines(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "doc_id int, text string")
    assert [(r.id, r.hits, r["rank"]) for r in search.search(docs, ["A", "b"]).collect()] == [(1, 3, 1), (2, 1, 2)]
    line = search.result_line(F.lit(1), F.lit(None), F.lit(""), F.lit("u"), F.lit(" x  y "))
    assert spark.range(1).select(line).first()[0] == "1. (untitled) — u\n   x y"


def test_verdicts(spark):
    schema = "status string, fabricated array<string>, omitted array<string>, missing array<string>, recovered array<string>, expect_warning boolean, warned boolean, expect_silent boolean, price_warning boolean"

    def verdict(rows):
        return evaluation.verdict(spark.createDataFrame([(s, f, o, [], [], False, False, False, False) for s, f, o in rows], schema)).first().verdict

    ok = ("pass", [], [])
    assert verdict([ok] * 5) == "GREEN"
    assert verdict([ok] * 5 + [("FAIL", ["$1"], [])]) == "RED"
    assert verdict([ok] * 5 + [("FAIL", [], ["$1"])] * 2) == "YELLOW"
    assert verdict([ok] + [("timeout", [], [])]) == "NO VERDICT"


def test_files_as_responses(spark, tmp_path):
    (tmp_path / "a.html").write_text("<article><p>some words of text here</p></article>")
    (tmp_path / "b.pdf").write_bytes(b"not a pdf")
    rows = {r.content_type: r for r in responses.pdf_text(responses.from_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"text/html", "application/pdf"} and rows["application/pdf"].pdf_text is None
    got = responses.from_files(spark, str(tmp_path / "a.html")).select(dom.parsed(F.col("body"))["markdown"].alias("m")).first().m
    assert got == "some words of text here"


def test_spill_copies(spark, tmp_path):
    rows = spark.createDataFrame([("https://a.b/x/", "body")], "url string, body string")
    responses.write_pages(rows, str(tmp_path / "pages"))
    r = spark.read.parquet(str(tmp_path / "pages")).first()
    assert r.markdown == "body" and len(r.copy) == 12 and r.copy.startswith(str(r.part)[:2])


def test_parse_gives_the_fields_asked_for():
    page = "<title>T</title><p>words</p><style>x</style>"
    whole = dom.parse(page)
    assert list(whole) == list(dom.FIELDS)
    for fields in (("oracle",), ("title", "markdown"), ("description",)):
        assert dom.parse(page, fields=fields) == {name: whole[name] for name in fields}


@pytest.mark.parametrize("name", ["oracle_text", "scrape_outcome", "scrape_store", "scrape_report"])
def test_pages_of_one_row_group_are_parsed_once_by_all_cores(spark, sf_dir, name):
    from loomspan.plans import registry

    rows = registry.queries()[name](spark, sf_dir)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert rows.rdd.getNumPartitions() >= 4
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Exchange hashpartitioning") < plan.index("FileScan")
