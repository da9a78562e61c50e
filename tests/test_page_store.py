import random

from pyspark.sql import functions as F

from loomspan.operators import page_store

from .test_operators import replay

SCHEMA = "url_hash string, seq long, via string"


def kept(spark, path, **limits):
    return page_store.KeyedStore(spark, str(path), SCHEMA, "url_hash", order="seq", fold=page_store.browser_first, **limits)


def test_batches_equal_a_replay_and_write_their_buckets(spark, tmp_path):
    rng = random.Random(6)
    log = [{"url_hash": f"k{rng.randrange(40)}", "seq": i, "via": rng.choice(["httpx", "playwright"]), "force": rng.random() < 0.2} for i in range(120)]
    held = kept(spark, tmp_path / "s", buckets=8)
    schema = SCHEMA + ", force boolean"
    for i in range(0, 120, 40):
        held.put(spark.createDataFrame(log[i : i + 40], schema), force="force")
        assert {r.url_hash: r.seq for r in held.read().collect()} == replay(log[: i + 40])
    before = held.version()["buckets"]
    n = held.put(spark.createDataFrame([("k1", 1000, "httpx", True), (None, 1001, "httpx", True)], schema), force="force")
    after = held.version()["buckets"]
    assert n == 1 and sum(before.get(k) != p for k, p in after.items()) == 1
    assert held.read().where("url_hash = 'k1'").first().seq == 1000
    assert kept(spark, tmp_path / "s", buckets=99).buckets == 8  # as the first version has it


def test_prune_writes_touched_buckets_and_vacuum(spark, tmp_path):
    home = page_store.Home(spark, str(tmp_path / "home"), buckets=4)
    pages = spark.createDataFrame([(f"https://a.b/{i}", f"https://a.b/{i}", 200, "text/html", "httpx", "<p>x</p>", "x", "t") for i in range(12)], "url string, final_url string, status int, content_type string, via string, html string, markdown string, title string")
    home.put_pages(pages.where("url < 'https://a.b/5'"), 100)
    home.put_pages(pages.where("url >= 'https://a.b/5'"), 200)
    home.robots.put(spark.createDataFrame([("https://a.b", "", 100), ("https://c.d", "", 200)], page_store.ROBOTS))
    home.crawls.put(spark.createDataFrame([("c1", "u", 1, 2, "o"), ("c1", "u", 5, 3, "o")], page_store.CRAWLS))
    assert home.counts() == {"pages": 12, "robots": 2, "crawls": 1} and home.crawls.read().first().pages == 3
    young = home.pages.lookup(pages.select(F.substring(F.sha2("url", 256), 1, 32).alias("url_hash")), 50, 240)
    assert {r.url for r in young.collect()} == {f"https://a.b/{i}" for i in range(5, 10)}
    removed = home.pages.read().where("fetched_at = 100").count() + 1
    assert home.prune(50, 150) == removed
    assert home.counts()["pages"] == 13 - removed and home.prune(50, 150) == 0
    assert home.pages.vacuum() > 0 and home.counts()["pages"] == 13 - removed
    assert home.clear() == 15 - removed and home.counts() == {"pages": 0, "robots": 0, "crawls": 0}
    assert page_store.Home.is_one(spark, str(tmp_path / "home")) and not page_store.Home.is_one(spark, str(tmp_path))


def test_a_batch_that_comes_again_and_one_that_fails(spark, tmp_path):
    held = kept(spark, tmp_path / "s", buckets=2)
    one = spark.createDataFrame([("a", 1, "httpx", False)], SCHEMA + ", force boolean")
    assert held.put(one, force="force", stream=("in", 0)) == 1
    assert held.put(one.withColumn("seq", F.lit(9).cast("long")), force="force", stream=("in", 0)) == 0
    assert held.read().first().seq == 1
    broken = one.withColumn("via", F.raise_error(F.lit("lost")).cast("string"))
    try:
        held.put(broken, force="force")
        raise AssertionError("it did not fail")
    except Exception as e:
        assert "lost" in str(e)
    assert [tuple(r) for r in held.read().collect()] == [("a", 1, "httpx")]


def test_empty_batches(spark, tmp_path):
    held = kept(spark, tmp_path / "s")
    none = spark.createDataFrame([], SCHEMA + ", force boolean")
    assert held.put(none, force="force") == 0 and held.read().count() == 0
    held.put(none, force="force", stream=("in", 3))
    assert held.read().count() == 0 and held.version()["streams"] == {"in": 3}
