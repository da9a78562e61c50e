import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan import api
from loomspan.operators import crawl, frontier

from .test_api import page, row, web  # noqa: F401


def levels(edges, seeds, depth):
    met = {s: 0 for s in seeds}
    last = set(seeds)
    for d in range(1, depth + 1):
        last = {b for a, b in edges if a in last} - set(met)
        met.update(dict.fromkeys(last, d))
    return met


@pytest.mark.parametrize("buckets", [None, 16])
def test_bfs_equals_a_walk(spark, buckets):
    rng = random.Random(2)
    edges = [(f"u{rng.randrange(120)}", f"u{rng.randrange(120)}") for _ in range(230)] + [("u1", None), (None, "u2")]
    e, s = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("u1",), ("u5",), ("u1",)], "url string")
    got = {r.url: r.depth for r in crawl.bfs(e, s, max_depth=9, buckets=buckets).collect()}
    want = levels([x for x in edges if None not in x], ["u1", "u5"], 9)
    assert got == want and max(got.values()) > 3


def test_no_seeds_and_no_edges(spark):
    e = spark.createDataFrame([], "src string, dst string")
    assert crawl.bfs(e, spark.createDataFrame([], "url string"), max_depth=2).collect() == []
    assert [tuple(r) for r in crawl.bfs(e, spark.createDataFrame([("a",)], "url string"), max_depth=2).collect()] == [("a", 0)]


def test_a_level_shuffles_its_frontier_alone(spark):
    """Neither what was visited nor the pages are exchanged: only the frontier's side of each join is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = frontier.Visited(spark, ["url"], 16)
        seen.add_new(spark.range(1000).select(F.col("id").cast("string").alias("url")), 0)
        step = spark.range(900, 1100).select(F.col("id").cast("string").alias("url"))
        plan = step.join(seen.rows().select("url"), ["url"], "left_anti")._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Bucketed: true" in plan
        new = seen.add_new(step, 1)
        assert sorted(int(r.url) for r in new.collect()) == list(range(1000, 1100))
        assert seen.rows().count() == 1100
        seen.drop()

        pages = spark.range(3000).select(F.concat(F.lit("https://h.example/"), F.col("id").cast("string")).alias("url"), F.lit("x").alias("html"))
        web = frontier.Web.write(pages.union(pages), 16)
        asked = pages.select("url").where("url < 'https://h.example/2'")
        plan = web.lookup(asked, 10_000)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Bucketed: true" in plan
        few = web.lookup(asked.limit(2), 2)._jdf.queryExecution().executedPlan().toString()
        picked = re.search(r"SelectedBucketsCount: (\d+) out of 16", few)
        assert picked and int(picked.group(1)) <= 2
        assert web.rows().count() == 3000
        web.drop()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_web_serves_many_crawls(spark, web):  # noqa: F811
    dealt = frontier.Web.write(web)
    for start, depth in (("https://site.example/", 2), ("https://site.example/b", 1)):
        same = [sorted((r.path, r.depth, r.outcome, r.number or 0) for r in api.crawl(w, start, max_depth=depth).collect()) for w in (web, dealt)]
        assert same[0] == same[1] and len(same[0]) > 2
    dealt.drop()


def test_crawl_without_its_start(spark, web):  # noqa: F811
    got = api.crawl(web, "https://nowhere.example/").collect()
    assert [(r.outcome, r.reason) for r in got] == [("error", "no response")]


def test_repeated_and_null_responses(spark):
    s = "https://r.example"
    rows = [row(s, page("Home", "/a")), row(s, page("Home", "/a")), row(f"{s}/a", page("A")), row(f"{s}/a/", page("A")), row(None, None)]
    schema = "url string, final_url string, status int, content_type string, html string, via string, error string"
    got = api.crawl(spark.createDataFrame(rows, schema), s).collect()
    assert sorted((r.path, r.title) for r in got) == [("/", "Home"), ("/a", "A")]
