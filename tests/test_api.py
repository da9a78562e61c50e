import json
import time

import pytest
from pyspark.sql import functions as F

from loomspan import api, cli

SCHEMA = "url string, final_url string, status int, content_type string, html string, via string, error string"
PROSE = "Plain words of a page that has enough text to stand for itself. " * 6


def page(title, *hrefs):
    return f"<html><body><article><h1>{title}</h1><p>{PROSE}</p></article>" + "".join(f'<a href="{h}">x</a>' for h in hrefs) + "</body></html>"


def row(url, html, status=200, kind="text/html", error=None):
    return (url, url, status, kind, html, "httpx", error)


@pytest.fixture(scope="module")
def web(spark):
    s = "https://site.example"
    rows = [
        row(s, page("Home", "/a", "/b/", "/a#x", "/logo.png", "https://other.example/", "/private/p", "mailto:x@y")),
        row(f"{s}/a", page("Page A", "/c", "/missing", "/")),
        row(f"{s}/b", page("Page B", "/c?utm_source=q", "/data.json")),
        row(f"{s}/c", page("Page C", "/deep")),
        row(f"{s}/deep", page("Deep")),
        row(f"{s}/missing", "gone", status=404),
        row(f"{s}/data.json", '{"b": 1, "a": [2]}', kind="application/json"),
        row(f"{s}/private/p", page("Private")),
        row(f"{s}/robots.txt", "User-agent: *\nDisallow: /private/\n", kind="text/plain"),
        row(f"{s}/sitemap.xml", f"<sitemapindex><sitemap><loc>{s}/s1.xml</loc></sitemap></sitemapindex>", kind="text/xml"),
        row(f"{s}/s1.xml", f"<urlset><url><loc>{s}/a</loc></url><url><loc>{s}/only-listed</loc></url></urlset>", kind="text/xml"),
        row(f"{s}/shell", '<div id="root"></div>'),
        row(f"{s}/wall", "<p>Verify you are a human</p>"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_crawl(spark, web):
    rows = {r.path: r for r in api.crawl(web, "https://Site.example/", max_depth=2).collect()}
    assert {p: r.depth for p, r in rows.items() if r.outcome == "saved"} == {"/": 0, "/a": 1, "/b": 1, "/c": 2}
    assert rows["/missing"].outcome == "error" and rows["/missing"].reason == "404"
    assert rows["/private/p"].outcome == "skipped_robots" and rows["/data.json"].outcome == "skipped_type"
    assert rows["/"].file == "001-home.md" and rows["/c"].number == 4
    assert {r.path for r in api.crawl(web, "https://site.example", exclude=["/b*"], max_depth=1).collect()} == {"/", "/a", "/private/p"}
    assert api.crawl(web, "https://site.example", max_pages=2).where("outcome = 'saved'").count() == 2


def test_map(web):
    rows = api.map_site(web, "https://site.example/").collect()
    assert [(r.source, r.display) for r in rows] == [("sitemap", "/a"), ("sitemap", "/only-listed"), ("links", "/b"), ("links", "/private/p")]
    assert [r.display for r in api.map_site(web, "https://site.example/", search="LIST", use_sitemap=True).collect()] == ["/only-listed"]
    assert api.map_site(web, "https://site.example/", use_sitemap=False, max_urls=1).count() == 1


def test_scrape(spark, web):
    asked = spark.createDataFrame([(f"https://site.example/{p}",) for p in ("a", "missing", "data.json", "shell", "wall", "nowhere")], "url string")
    got = {r.url.rpartition("/")[2]: r for r in api.scrape(asked, web, max_length=120).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "content", "missing": "http_error", "data.json": "json", "shell": "shell", "wall": "blocked_raw", "nowhere": "fetch_error"}
    assert got["a"].report.startswith("url: https://site.example/a\ntitle: Page A\nfetched: live | via: httpx\ntokens: ~") and "truncated; full copy" in got["a"].report
    assert got["missing"].report == "error fetching https://site.example/missing: HTTP 404"
    assert '"a": [' in got["data.json"].report and "shell" in got["shell"].report
    shots = spark.createDataFrame([row("https://site.example/shell", page("Rendered"))], SCHEMA)
    again = api.scrape(asked.where("url like '%shell'"), web, rendered=shots).first()
    assert again.outcome == "content" and again.title == "Rendered" and again.via == "playwright"


def test_cache_is_read_and_judged_anew(spark, web):
    asked = spark.createDataFrame([("https://site.example/a",), ("https://site.example/b",), ("https://site.example/c",)], "url string")
    base = web.where(F.col("url").isin([r.url for r in asked.collect()]))
    old = api.scrape(asked, base).withColumn("fetched_at", F.when(F.col("url").endswith("/c"), 10).otherwise(1000).cast("long"))
    old = old.withColumn("html", F.when(F.col("url").endswith("/b"), F.lit("<p>We use cookies here</p>")).otherwise(F.regexp_replace("html", "Page A", "Cached A")))
    got = {r.url[-1]: r for r in api.scrape(asked, web, cache=old, now=604_900).collect()}
    assert got["a"].from_cache and got["a"].title == "Cached A" and "fetched: cache 1970-01-01" in got["a"].report
    assert not got["b"].from_cache and got["b"].title == "Page B"
    assert not got["c"].from_cache
    assert not any(r.from_cache for r in api.scrape(asked, web, cache=old, now=604_900, fresh=True).collect())


def test_extract_and_search(spark, web):
    html = "<script type='application/ld+json'>{\"@type\": \"X\"}</script><table><tr><td>1</td></tr></table>"
    t = spark.createDataFrame([row("https://s.e/1", html), row("https://s.e/2", "x", status=500)], SCHEMA)
    got = {r.url[-1]: json.loads(r.data) for r in api.extract(t, t).collect()}
    assert got["1"]["tables"][0]["rows"] == [["1"]] and got["1"]["json_ld"] == [{"@type": "X"}] and got["2"] == {"url": "https://s.e/2", "error": "HTTP 500"}
    assert json.loads(api.extract(t, t, types=("opengraph",)).where("url like '%1'").first().data)["note"]
    docs = spark.createDataFrame([(1, "apple pie"), (2, "apple apple")], "doc_id int, text string")
    assert [r.id for r in api.search(docs, "apple").orderBy("rank").collect()] == [2, 1]


def test_command_line(spark, web, tmp_path):
    path = str(tmp_path / "web")
    web.withColumn("fetched_at", F.lit(5).cast("long")).write.parquet(path)
    out = cli.run(spark, ["crawl", path, "https://site.example/", "--max-depth", "1"])
    assert out[0] == "crawl: site.example  pages: 3  errors: 0  skipped(robots/dupe/type): 1" and out[1].startswith("001-home.md")
    assert cli.run(spark, ["map", path, "https://site.example/", "--max-urls", "2"]) == ["site: https://site.example — 4 urls (sitemap 2, links 2); showing 2", "/a", "/only-listed"]
    assert "Page A" in cli.run(spark, ["scrape", path, "https://site.example/a"])[0]
    assert json.loads(cli.run(spark, ["extract", path, "https://site.example/a"])[0])["note"]
    stats = cli.run(spark, ["cache", "stats", path])
    assert stats[0] == "pages: 13" and int(stats[1].removeprefix("bytes: ")) > 0
    assert cli.run(spark, ["cache", "prune", path, "--out", str(tmp_path / "kept")])[0].startswith("13 rows removed")


def test_crawl_folder(spark, web, tmp_path):
    path, out = str(tmp_path / "web"), tmp_path / "crawl"
    web.write.parquet(path)
    for _ in range(2):  # a second run puts the same files
        said = cli.run(spark, ["crawl", path, "https://site.example/", "--out", str(out)])
    names = sorted(p.name for p in out.iterdir() if not p.name.startswith("."))
    assert names == ["001-home.md", "002-page-a.md", "003-page-b.md", "004-page-c.md", "INDEX.md", "index.json"]
    assert (out / "INDEX.md").read_text() == "\n".join(said) + "\n" and said[1] == f"dir: {out}" and said[-1] == "errors: /missing (404)"
    index = json.loads((out / "index.json").read_text())
    assert [e["file"] for e in index] == names[:4] and list(index[0]) == ["url", "title", "file", "tokens"]
    text = (out / "002-page-a.md").read_text()
    assert text.startswith("---\nurl: https://site.example/a\ntitle: Page A\nfetched: ") and "Plain words" in text


def test_cache_verbs_change_the_store(spark, web, tmp_path):
    home, now = tmp_path / "store", int(time.time())
    aged = web.withColumn("fetched_at", F.when(F.col("status") == 404, 5).otherwise(now).cast("long"))
    aged.write.parquet(str(home / "pages"))
    spark.createDataFrame([("https://a.example", "", 5), ("https://b.example", "", now)], "site string, body string, fetched_at long").write.parquet(str(home / "robots"))
    spark.createDataFrame([("c", "u", 5)], "crawl_id string, root_url string, started_at long").write.parquet(str(home / "crawls"))
    counts = lambda: cli.run(spark, ["cache", "stats", str(home)])[:3]
    assert cli.run(spark, ["cache", "prune", str(home)]) == ["2 rows removed"]
    assert counts() == ["pages: 12", "robots: 1", "crawls: 1"]
    assert cli.run(spark, ["cache", "clear", str(home)]) == ["14 rows removed"]
    assert counts() == ["pages: 0", "robots: 0", "crawls: 0"]
    assert sorted(p.name for p in home.iterdir()) == ["crawls", "pages", "robots"]


def test_a_challenge_is_passed_by_a_rendering(spark):
    url = "https://site.example/"
    asked = spark.createDataFrame([(url + p,) for p in ("c", "d", "e")], "url string")
    live = spark.createDataFrame([row(url + "c", "<title>Just a moment</title>", 503), row(url + "d", "down", 503), row(url + "e", "<title>Just a moment</title>", 403)], SCHEMA)
    shots = spark.createDataFrame([row(url + "c", page("Behind")), row(url + "d", page("Other")), row(url + "e", "", error="crash")], SCHEMA)
    got = {r.url[-1]: r for r in api.scrape(asked, live, rendered=shots).collect()}
    assert got["c"].outcome == "content" and got["c"].title == "Behind" and got["c"].via == "playwright"
    assert got["d"].outcome == "http_error" and got["e"].outcome == "http_error"


def test_robots_entries_answer_while_young(spark, web):
    entry = spark.createDataFrame([("https://site.example", "User-agent: *\nDisallow: /a\n", 1000)], "site string, body string, fetched_at long")
    met = lambda now: {r.path: r.outcome for r in api.crawl(web, "https://site.example/", max_depth=1, robots_cache=entry, now=now).collect()}
    young, old = met(1000 + 86_399), met(1000 + 86_400)
    assert young["/a"] == "skipped_robots" and young["/private/p"] == "saved"
    assert old["/a"] == "saved" and old["/private/p"] == "skipped_robots"


def test_api_and_command_line_agree(spark, web, tmp_path):
    path = str(tmp_path / "web")
    web.write.parquet(path)
    url = "https://site.example/b"
    asked = spark.createDataFrame([(url,)], "url string")
    assert cli.run(spark, ["scrape", path, url]) == [api.scrape(asked, web).first().report]
    assert cli.run(spark, ["extract", path, url]) == [api.extract(asked, web).first().data]
    assert cli.run(spark, ["map", path, url])[1:] == [r.display for r in api.map_site(web, url).collect()]
