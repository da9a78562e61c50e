"""A keyed store that a batch changes bucket by bucket.

Rows lie in buckets by the hash of their key. A batch reads and writes the buckets of its own keys alone,
into a folder of its own; a small version file then says for each bucket which
folder holds it. Readers follow the newest version file, so they see a batch whole or not
at all, and a batch that fails leaves nothing visible. A batch that a stream hands over again is
known by its number and skipped. One writer at a time; folders that no
version names any more go with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from . import store

PAGES = "url_hash string, url string, final_url string, fetched_at long, status int, content_type string, via string, html string, markdown string, title string"
ROBOTS = "site string, body string, fetched_at long"
CRAWLS = "crawl_id string, root_url string, started_at long, pages long, out_dir string"


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The last write of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "_order").alias("_row")).select("_row.*")


def browser_first(rows: DataFrame, key: str) -> DataFrame:
    """The write that an upsert of pages keeps; a kept row's own force is over."""
    return store.upsert(rows.withColumn("_force", F.coalesce("_force", F.lit(False)) & (F.col("_order._rank") == 1)), key=key, seq="_order", force="_force")


class KeyedStore:
    """Rows by ``key`` under ``path``; ``fold`` says which of several rows of a key stays.

    ``buckets`` is fixed by the first version. A bucket is what one task writes, so take as
    many as keep a bucket at some hundred megabytes.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, *, order: str = "fetched_at", fold: Callable[[DataFrame, str], DataFrame] = newest, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.order, self.fold = spark, path.rstrip("/"), schema, key, order, fold
        self.columns = spark.createDataFrame([], schema).columns
        self.fs, self.make = store._files(spark, self.path)
        self.buckets = self.version().get("n", buckets)

    # -- versions

    def _versions(self) -> list[str]:
        folder = self.make(f"{self.path}/_versions")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self) -> dict:
        """The newest version: its number, folders by bucket, and the last batch of each stream."""
        names = self._versions()
        if not names:
            return {"version": 0, "buckets": {}, "streams": {}}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/_versions/{names[-1]}").collect()))

    def _publish(self, now: dict, folders: dict[int, str | None], stream: tuple[str, int] | None) -> None:
        kept = {k: v for k, v in now["buckets"].items() if int(k) not in folders} | {str(k): v for k, v in folders.items() if v}
        streams = now["streams"] | ({stream[0]: stream[1]} if stream else {})
        text = json.dumps({"version": now["version"] + 1, "n": self.buckets, "buckets": kept, "streams": streams})
        name = f"{now['version'] + 1:012d}.json"
        draft, final = self.make(f"{self.path}/_versions/.{uuid.uuid4().hex}"), self.make(f"{self.path}/_versions/{name}")
        out = self.fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            raise OSError(f"{name} of {self.path} is there already: two writers at once")

    # -- rows

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        held = self.version()["buckets"]
        paths = [f"{self.path}/{p}" for k, p in held.items() if buckets is None or int(k) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def lookup(self, keys: DataFrame, ttl_seconds: int, now: int) -> DataFrame:
        """Entries of the given keys that are younger than the TTL, from the keys' buckets alone."""
        touched = [r.b for r in keys.select(self.bucket().alias("b")).distinct().collect()]
        return store.ttl_read(keys.select(self.key).distinct(), self.read(touched), ttl_seconds=ttl_seconds, now=now, key=self.key)

    def _write(self, rows: DataFrame, touched: list[int], stream: tuple[str, int] | None, now: dict) -> None:
        folder = f"data/{uuid.uuid4().hex}"
        rows = rows.select(*self.columns, self.bucket().alias("_bucket"))
        rows.repartition(max(1, min(len(touched), self.buckets)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {b: f"{folder}/_bucket={b}" for b in touched}
        self._publish(now, {b: p if self.fs.exists(self.make(f"{self.path}/{p}")) else None for b, p in there.items()}, stream)

    def put(self, rows: DataFrame, *, force: str | None = None, order: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Fold ``rows`` in, in the order of ``order``; gives the number of buckets that were written.

        ``stream`` is a stream's name and the number of its batch. Rows without key are left out.
        """
        now = self.version()
        if stream and now["streams"].get(stream[0], -1) >= stream[1]:
            return 0
        forced = F.col(force) if force else F.lit(False)
        seq = F.col(order or self.order)
        new = rows.where(F.col(self.key).isNotNull()).select(*self.columns, forced.alias("_force"), F.struct(F.lit(1).alias("_rank"), seq.cast("long").alias("_seq")).alias("_order"))
        touched = sorted(r.b for r in new.select(self.bucket().alias("b")).distinct().collect())  # buckets at most
        if not touched and not stream:
            return 0
        old = self.read(touched).withColumns({"_force": F.lit(False), "_order": F.struct(F.lit(0).alias("_rank"), F.lit(0).cast("long").alias("_seq"))})
        self._write(self.fold(old.unionByName(new), self.key), touched, stream, now)
        return len(touched)

    def remove(self, old) -> int:
        """Take out the rows for which ``old`` holds; only their buckets are written. Gives their number."""
        counts = self.read().where(old).groupBy(self.bucket().alias("b")).count().collect()  # buckets at most
        if counts:
            touched = sorted(r.b for r in counts)
            self._write(self.read(touched).where(~F.coalesce(old, F.lit(False))), touched, None, self.version())
        return sum(r["count"] for r in counts)

    def prune(self, older_than_seconds: int, now: int) -> int:
        return self.remove(store.is_expired(F.col("fetched_at"), now, older_than_seconds))

    def vacuum(self) -> int:
        """Delete folders and version files that the newest version does not need; gives the number of folders."""
        live = {p.split("/")[1] for p in self.version()["buckets"].values()}
        data = self.make(f"{self.path}/data")
        dead = [f.getPath() for f in self.fs.listStatus(data) if f.getPath().getName() not in live] if self.fs.exists(data) else []
        for name in self._versions()[:-1]:
            self.fs.delete(self.make(f"{self.path}/_versions/{name}"), False)
        for p in dead:
            self.fs.delete(p, True)
        return len(dead)


class Home:
    """The tables that the verbs fill: pages, robots files and crawls under one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        path = path.rstrip("/")
        self.pages = KeyedStore(spark, f"{path}/pages", PAGES, "url_hash", fold=browser_first, buckets=buckets)
        self.robots = KeyedStore(spark, f"{path}/robots", ROBOTS, "site", buckets=buckets)
        self.crawls = KeyedStore(spark, f"{path}/crawls", CRAWLS, "crawl_id", order="started_at", buckets=1)
        self.tables = {"pages": self.pages, "robots": self.robots, "crawls": self.crawls}

    @staticmethod
    def is_one(spark: SparkSession, path: str) -> bool:
        fs, make = store._files(spark, path)
        return any(fs.exists(make(f"{path.rstrip('/')}/{n}/_versions")) for n in ("pages", "robots", "crawls"))

    def put_pages(self, rows: DataFrame, now: int, *, key_url: str = "url", force: str | None = None) -> None:
        """Store pages (url, final_url, status, content_type, via, html, markdown, title) as fetched at ``now``."""
        entry = rows.withColumn("url_hash", U.url_hash(F.col(key_url))).withColumn("fetched_at", F.lit(now).cast("long"))
        self.pages.put(entry, force=force)

    def prune(self, older_than_seconds: int, now: int) -> int:
        """Old pages and robots files go; crawls stay."""
        return self.pages.prune(older_than_seconds, now) + self.robots.prune(older_than_seconds, now)

    def clear(self) -> int:
        return sum(t.remove(F.lit(True)) for t in self.tables.values())

    def counts(self) -> dict[str, int]:
        return {r.name: r.n for r in store.stats(**{n: t.read() for n, t in self.tables.items()}).collect()}
