"""Sinks, the live source, table functions and references in links."""

import html
import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomspan.functions import table_functions
from loomspan.operators import dom, links
from loomspan.sources import responses, sink

from .test_api import page


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((time.monotonic(), self.headers["Host"], self.path))
            big = self.path == "/big"
            self.send_response(404 if self.path == "/gone" else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            try:
                self.wfile.write(b"x" * (50_000_000 if big else 10))
            except OSError:  # the reader hung up
                asked.append((0, "cut", self.path))

        def log_message(self, *args):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1], asked
    s.shutdown()


def test_live_source(spark, server):
    port, asked = server
    hosts = [f"127.0.0.1:{port}", f"localhost:{port}"]
    urls = [(f"http://{h}/{p}", d) for h, d in zip(hosts, (None, 0.9)) for p in ("a", "b", "gone")] + [(f"http://{hosts[0]}/big", None), ("http://127.0.0.1:1/x", None), (None, None)]
    got = {r.url: r for r in responses.fetch(spark.createDataFrame(urls, "url string, crawl_delay double"), delay_seconds=0.3, max_bytes=100_000, tasks=2).collect()}
    assert len(got) == 8
    assert (got[f"http://{hosts[0]}/a"].status, got[f"http://{hosts[0]}/a"].html, got[f"http://{hosts[0]}/a"].content_type) == (200, "x" * 10, "text/html")
    assert got[f"http://{hosts[0]}/gone"].status == 404 and got["http://127.0.0.1:1/x"].error
    big = got[f"http://{hosts[0]}/big"]
    assert big.html is None and big.status == 200 and big.error == "response too large (>100000 bytes)"
    for h, pause in zip(hosts, (0.3, 0.9)):
        times = sorted(t for t, name, _ in asked if name == h)
        assert len(times) >= 3 and min(b - a for a, b in zip(times, times[1:])) >= pause - 0.02


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.createDataFrame([(f"{i}.md", f"text {i}") for i in range(20)], "file string, content string").repartition(4)
    broken = rows.withColumn("content", F.when(F.col("file") == "7.md", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        sink.write_files(broken, str(out))
    assert not out.exists() or list(out.iterdir()) == []
    for _ in range(2):  # the same files once more
        sink.write_files(rows, str(out))
        assert sorted(p.name for p in out.iterdir()) == sorted(f"{i}.md" for i in range(20))
    assert (out / "3.md").read_text() == "text 3"


def test_table_functions_in_sql(spark):
    table_functions.register(spark)
    body = page("T", "/a", "b?utm_source=x&z=1&y=2", "/a#top", "mailto:x@y", "HTTPS://Other.example/Q/") + "<table><caption>C</caption><tr><th>h</th></tr><tr><td>1</td><td>2</td></tr></table>"
    xml = "<urlset><url><loc> https://a.b/1 </loc></url><url><loc>https://a.b/2</loc></url></urlset>"
    spark.createDataFrame([(1, "https://s.example/d/", body, xml), (2, "https://s.example/", None, None)], "page_id int, url string, html string, body string").createOrReplaceTempView("fetched")
    got = spark.sql("SELECT page_id, pos, link FROM fetched, LATERAL extract_links(html, url) ORDER BY pos").collect()
    want = links.extract_links(spark.table("fetched")).orderBy("pos").collect()
    assert [(r.page_id, r.pos, r.link) for r in got] == [(r.page_id, r.pos, r.link) for r in want] and len(got) == 3
    tables = spark.sql("SELECT t.* FROM fetched, LATERAL html_tables(html) AS t").collect()
    assert [(t.number, t.caption, t.headers, t.rows, t.truncated) for t in tables] == [(0, "C", ["h"], [["1", "2"]], False)]
    assert tables[0].rows == spark.table("fetched").where("page_id = 1").select(dom.parsed(F.col("html"))["tables"].alias("t")).first().t[0].rows
    locs = spark.sql("SELECT pos, loc, is_index FROM fetched, LATERAL sitemap_locations(body) ORDER BY pos").collect()
    assert [tuple(r) for r in locs] == [(0, "https://a.b/1", False), (1, "https://a.b/2", False)]


def test_table_functions_on_the_pages(spark, sf_dir):
    table_functions.register(spark)
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("all_pages")
    got = spark.sql("SELECT page_id, link FROM all_pages, LATERAL extract_links(html, url)").collect()
    want = links.extract_links(spark.table("all_pages")).collect()
    assert sorted((r.page_id, r.link) for r in got) == sorted((r.page_id, r.link) for r in want) and got


def test_all_references_in_links(spark):
    names = sorted(html.entities.html5) + ["#65;", "#x42;", "#128;", "#0;", "#xD800;", "notareference;", "ampx", "copyright"]
    rows = [(i, "https://a.b/", f'<a href="/p?q=&{n}">x</a>') for i, n in enumerate(names) if not n.startswith(("Tab", "NewLine", "quot", "QUOT", "num;", "quest;"))]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    raw = df.select("page_id", F.explode(links.hrefs(F.col("html"))).alias("h")).select("page_id", links.T.decode_entities(F.col("h")).alias("h"))
    got = {r.page_id: r.h for r in raw.collect()}
    assert got == {i: html.unescape(h.split('"')[1]) for i, _, h in rows} and len(got) > 2200
