from pyspark.sql import functions as F

from loomspan.operators import store
from loomspan.streaming import pages

from .test_operators import replay

SCHEMA = "url string, seq int, via string, force boolean"


def test_stream_folds_to_the_same_store(spark, tmp_path):
    rows = [(f"https://a.b/{i % 7}", i, "playwright" if i % 3 == 0 else "httpx", i % 11 == 10) for i in range(60)]
    src = tmp_path / "in"
    for k in range(4):
        spark.createDataFrame(rows[k * 15 : k * 15 + 15], SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = pages.read_responses(spark, str(src), SCHEMA, files_per_trigger=1)
    q = pages.upsert_stream(stream, str(tmp_path / "store"), str(tmp_path / "ckpt"))
    assert q.awaitTermination(120)
    got = {r.url: r.seq for r in pages.read_store(spark, str(tmp_path / "store"), "url_hash string, " + SCHEMA).collect()}
    log = [dict(url_hash=u, seq=s, via=v, force=f) for u, s, v, f in rows]
    assert got == replay(log)
    batch = spark.createDataFrame(rows, SCHEMA).withColumn("url_hash", F.col("url"))
    assert {r.url: r.seq for r in store.upsert(batch).collect()} == got


def test_outcomes_run_on_a_stream(spark, tmp_path):
    schema = "url string, status int, content_type string, html string, error string"
    df = spark.createDataFrame([("https://a.b/1", 404, "text/html", "x", None), ("https://a.b/2", 200, "text/plain", "t", None)], schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = pages.judged(pages.read_responses(spark, str(tmp_path / "in"), schema)).select("url", "outcome")
    q = stream.writeStream.format("memory").queryName("judged").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.url[-1]: r.outcome for r in spark.sql("select * from judged").collect()} == {"1": "http_error", "2": "plain"}


def test_keys_expire_by_timer(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "url string, fetched_at long"
    try:
        for i, rows in enumerate(([("a", 100), ("b", 120)], [("a", 150), ("c", 210)], [("d", 400)], [("e", 401)])):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"n={i}"))
        stream = spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = pages.expired_keys(stream.drop("n"), 80).writeStream.format("memory").queryName("expired").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        # a was fetched again before it was old; d and e are young
        assert sorted(tuple(r) for r in spark.table("expired").collect()) == [("a", 150), ("b", 120), ("c", 210)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
