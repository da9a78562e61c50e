"""Responses as a table: from a page corpus, from files, or (where there is a network) live."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import urls as U
from ..operators.robots import effective_delay

SCHEMA = "url string, final_url string, status int, content_type string, html string, via string, error string"


def from_pages(pages: DataFrame) -> DataFrame:
    """A corpus of fetched pages as good HTML responses."""
    none = F.lit(None).cast("string")
    return pages.select("page_id", "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "html", F.lit("httpx").alias("via"), none.alias("error"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """Files (HTML, text, PDF) as responses with binary bodies."""
    ext = F.lower(F.substring_index("path", ".", -1))
    kind = F.when(ext == "pdf", "application/pdf").when(ext == "json", "application/json").when(ext == "txt", "text/plain").when(ext == "xml", "text/xml").otherwise("text/html")
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), F.col("path").alias("final_url"), F.lit(200).alias("status"), kind.alias("content_type"), F.col("content").alias("body"), F.lit("file").alias("via"), F.lit(None).cast("string").alias("error"))


class _Url(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.agent = options.get("useragent", "loomspan")
        self.timeout = float(options.get("timeout", "20"))
        self.cap = int(options.get("maxbytes", str(5 * 1024 * 1024)))

    def partitions(self):
        hosts: dict[str, list[str]] = {}
        for u in self.urls:  # one partition a host, so that a host is asked by one task
            hosts.setdefault(u.split("/")[2] if "//" in u else u, []).append(u)
        return [_Url(us) for us in hosts.values()]

    def read(self, partition):
        for u in partition.urls:
            yield get(u, self.agent, self.timeout, self.cap)


def get(url: str, agent: str, timeout: float, cap: int) -> tuple:
    """One response as a row; failures are rows too, and reading stops as soon as a body is over the cap."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            kind = r.headers.get("content-type", "").split(";")[0].strip().lower()
            parts, size = [], 0
            while size <= cap and (part := r.read(min(1 << 16, cap + 1 - size))):
                parts.append(part)
                size += len(part)
            big = size > cap
            return (url, r.url, r.status, kind, None if big else b"".join(parts).decode("utf-8", "replace"), "http", f"response too large (>{cap} bytes)" if big else None)
    except urllib.error.HTTPError as e:
        return (url, url, e.code, "", None, "http", None)
    except Exception as e:  # a source reports its failures as rows
        return (url, url, 0, "", None, "http", f"{type(e).__name__}: {e}")


def fetch(urls: DataFrame, *, agent: str = "loomspan/1.0", delay_seconds: float = 1.0, timeout_seconds: float = 20.0, max_bytes: int = 5 * 1024 * 1024, tasks: int | None = None) -> DataFrame:
    """Fetch the ``url`` of each row, as responses; a ``crawl_delay`` column holds what robots files ask for.

    All URLs of a host go to one task, which waits between two requests to it for the longer of ``delay_seconds``
    and the host's own delay (10 seconds at most); other hosts of the task are asked meanwhile, a URL each in turn.
    """
    delay = F.col("crawl_delay") if "crawl_delay" in urls.columns else F.lit(None)
    wait = effective_delay(delay.cast("double"), delay_seconds)
    rows = urls.where(F.col("url").isNotNull()).select("url", F.lower(U.netloc(F.col("url"))).alias("host"), wait.alias("wait"))
    # The n-th URL of each host before any n+1-th, so that the waits of hosts overlap.
    turn = F.row_number().over(Window.partitionBy("host").orderBy("url"))
    dealt = rows.withColumn("turn", turn).repartition(tasks or 64, "host").sortWithinPartitions("turn", "host")

    def run(batches):
        last: dict[str, float] = {}
        for batch in batches:
            for url, host, pause in zip(batch["url"], batch["host"], batch["wait"]):
                if host in last:
                    time.sleep(max(0.0, last[host] + pause - time.monotonic()))
                row = get(url, agent, timeout_seconds, max_bytes)
                last[host] = time.monotonic()
                yield pd.DataFrame([row], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return dealt.mapInPandas(run, SCHEMA)


class HttpSource(DataSource):
    """``spark.read.format("loomspan-http").option("urls", "one a line").load()``."""

    @classmethod
    def name(cls) -> str:
        return "loomspan-http"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _HttpReader({k.lower(): v for k, v in self.options.items()})


def pdf_text(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``pdf_text``: pages' texts with blank lines between; null without a PDF library or for a bad file."""
    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        try:
            from pypdf import PdfReader
        except ImportError:
            return pd.Series([None] * len(bodies))
        from io import BytesIO

        def one(b):
            try:
                pages = [(p.extract_text() or "").strip() for p in PdfReader(BytesIO(bytes(b))).pages]
            except Exception:
                return None
            return "\n\n".join(p for p in pages if p) or None

        return bodies.map(one, na_action="ignore")

    return df.withColumn("pdf_text", run(F.col(body)))


def write_pages(rows: DataFrame, path: str, body: str = "body") -> None:
    """The full copies of formatted pages, by the first 12 digits of their URL's hash, partitioned by the first two."""
    from ..functions.urls import url_hash

    name = F.substring(url_hash(F.col("url")), 1, 12)
    rows.select(name.alias("copy"), F.col(body).alias("markdown"), F.substring(name, 1, 2).alias("part")).write.mode("overwrite").partitionBy("part").parquet(path)
