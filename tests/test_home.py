"""The verbs on their store."""

import json

from pyspark.sql import functions as F

from loomspan import api, cli
from loomspan.operators.page_store import Home

from .test_api import SCHEMA, page, row, web  # noqa: F401

S = "https://site.example"


def asked(spark, *paths):
    return spark.createDataFrame([(f"{S}/{p}",) for p in paths], "url string")


def test_scrape_fills_the_store_and_reads_it(spark, web, tmp_path):  # noqa: F811
    home = Home(spark, str(tmp_path / "home"), buckets=4)
    first = api.scrape_and_store(asked(spark, "a", "missing", "wall", "shell", "data.json"), web, home, now=1000)
    assert not any(r.from_cache for r in first.collect())
    held = home.pages.read().collect()
    assert [(r.url, r.fetched_at, r.title, r.via) for r in held] == [(f"{S}/a", 1000, "Page A", "httpx")] and "Plain words" in held[0].markdown
    changed = web.withColumn("html", F.regexp_replace("html", "Page A", "Changed A"))
    again = {r.url[-1]: r for r in api.scrape_and_store(asked(spark, "a", "b"), changed, home, now=1500).collect()}
    assert again["a"].from_cache and again["a"].title == "Page A" and not again["b"].from_cache
    assert home.counts()["pages"] == 2
    late = api.scrape_and_store(asked(spark, "a"), changed, home, now=1000 + 7 * 86_400).first()
    assert not late.from_cache and home.pages.read().where("url like '%/a'").first().title == "Changed A"


def test_a_stored_wall_is_replaced_even_by_a_plain_fetch(spark, web, tmp_path):  # noqa: F811
    home = Home(spark, str(tmp_path / "home"), buckets=2)
    wall = "<html><body><article><p>We use cookies here</p></article></body></html>"
    rows = spark.createDataFrame([(f"{S}/b", f"{S}/b", 200, "text/html", "playwright", wall, "We use cookies here", "t")], "url string, final_url string, status int, content_type string, via string, html string, markdown string, title string")
    home.put_pages(rows, 900)
    got = api.scrape_and_store(asked(spark, "b"), web, home, now=1000).first()
    assert not got.from_cache and got.title == "Page B"
    assert [(r.via, r.title) for r in home.pages.read().collect()] == [("httpx", "Page B")]


def test_extract_on_the_store(spark, tmp_path):
    home = Home(spark, str(tmp_path / "home"), buckets=2)
    html = "<table><tr><td>{}</td></tr></table>"
    live = lambda x: spark.createDataFrame([row(f"{S}/t", html.format(x)), row(f"{S}/bad", "x", status=500)], SCHEMA)
    cell = lambda df: json.loads(df.where("url like '%/t'").first().data)["tables"][0]["rows"][0][0]
    assert cell(api.extract_and_store(asked(spark, "t", "bad"), live(1), home, now=10)) == "1"
    held = home.pages.read().collect()
    assert [(r.url, r.markdown, r.title) for r in held] == [(f"{S}/t", None, None)]
    assert cell(api.extract_and_store(asked(spark, "t"), live(2), home, now=20)) == "1"
    assert cell(api.extract_and_store(asked(spark, "t"), live(2), home, now=10 + 7 * 86_400)) == "2"


def test_crawl_and_command_line_on_a_home(spark, web, tmp_path):  # noqa: F811
    path, home = str(tmp_path / "web"), str(tmp_path / "home")
    web.write.parquet(path)
    out = cli.run(spark, ["crawl", path, f"{S}/", "--max-depth", "1", "--home", home])
    assert out[0].startswith("crawl: site.example  pages: 3")
    assert cli.run(spark, ["cache", "stats", home])[:3] == ["pages: 3", "robots: 1", "crawls: 1"]
    held = Home(spark, home)
    assert "Disallow: /private/" in held.robots.read().first().body
    log = held.crawls.read().first()
    assert (log.root_url, log.pages) == (f"{S}/", 3)
    said = cli.run(spark, ["scrape", path, f"{S}/a", "--home", home])[0]
    assert "fetched: cache " in said
    assert cli.run(spark, ["cache", "prune", home]) == ["0 rows removed"]
    assert cli.run(spark, ["cache", "clear", home]) == ["5 rows removed"]
    assert cli.run(spark, ["cache", "stats", home])[:3] == ["pages: 0", "robots: 0", "crawls: 0"]


def test_settings_come_from_the_environment(monkeypatch):
    monkeypatch.setenv("LOOMSPAN_UA", "me/1")
    monkeypatch.setenv("LOOMSPAN_TTL", "60")
    monkeypatch.setenv("LOOMSPAN_HOME", "/x")
    got = api.Settings.from_environment()
    assert (got.user_agent, got.page_ttl_seconds, got.delay_seconds) == ("me/1", 60, 1.0) and api.home_folder() == "/x"
