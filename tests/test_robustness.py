"""Odd pages must not end a job, and plans must not grow with the uses of a value."""

import json

from pyspark.sql import functions as F

from loomspan.operators import dom, links, scrape
from loomspan.plans import registry


def test_long_tags_and_odd_attributes(spark):
    pages = [
        (1, "<a " + "x" * 20_000),
        (2, "<a " + "b='c' " * 20_000 + "href=/far>t</a>"),
        (3, "<a title=\"href='/no'\" href='/yes'>t</a><A HREF = /b?x=1&amp;y=2>u</A><a name=z>v</a>"),
        (4, "<a href='" + "q" * 50_000 + "'>t</a>" + "<a " * 5_000),
        (5, None),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string").withColumn("url", F.lit("https://h.example/p"))
    rows = {(r.page_id, r.link) for r in links.extract_links(df).collect()}
    assert (2, "https://h.example/far") in rows and (3, "https://h.example/yes") in rows and (3, "https://h.example/b?x=1&y=2") in rows
    assert not any("no" in link for i, link in rows if i == 3) and sum(i == 3 for i, _ in rows) == 2


def test_deep_pages(spark):
    deep = "<div>" * 50_000 + "the text" + "</div>" * 50_000
    items = "<div itemscope itemprop=a>" * 5_000 + "x"
    ld = "<script type='application/ld+json'>" + "[" * 100_000 + "</script><p>after</p>"
    df = spark.createDataFrame([(1, deep), (2, "<div itemscope>" + items), (3, ld)], "i int, h string")
    got = {r.i: r.p for r in df.select("i", dom.parsed(F.col("h")).alias("p")).collect()}
    assert "the text" in got[1].markdown and got[2] is not None and "after" in got[3].oracle and got[3].json_ld == []
    odd = "[" * 100_000
    assert spark.range(1).select(dom.pretty_json(F.lit(odd))).first()[0] == odd


def test_structured_data_is_nested_json(spark):
    page = """<script type='application/ld+json'>[{"b": {"c": [1, "x"]}}, 7]</script><meta property='og:title' content='a "b"'>
    <div itemscope itemtype=T><span itemprop=n>v</span></div><table><tr><th>h</th></tr><tr><td>1</td></tr></table>"""
    row = spark.createDataFrame([(page,)], "h string").select(dom.parsed(F.col("h")).alias("p"))
    whole = json.loads(row.select(scrape.structured(F.col("p"), F.lit("u"))).first()[0])
    assert whole == {
        "url": "u",
        "json_ld": [{"b": {"c": [1, "x"]}}, 7],
        "opengraph": {"og:title": 'a "b"'},
        "microdata": [{"type": "T", "properties": {"n": "v"}}],
        "tables": [{"headers": ["h"], "rows": [["1"]], "truncated": False}],
    }
    some = json.loads(row.select(scrape.structured(F.col("p"), F.lit("u"), ("microdata",))).first()[0])
    assert set(some) == {"url", "microdata"}
    assert json.loads(row.select(scrape.structured(F.col("p"), F.lit("u"), ())).first()[0])["note"]


def test_plans_stay_small(spark, sf_dir):
    for name in ("site_sources", "map_site", "page_links"):
        df = registry.queries()[name](spark, sf_dir)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract") < 400 and len(plan) < 200_000, name
