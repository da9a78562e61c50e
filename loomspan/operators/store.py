"""Keyed page store: reads by age, conflict-resolving upserts, pruning, counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROWSER = "playwright"


def ttl_read(requests: DataFrame, store: DataFrame, *, ttl_seconds: int, now: int, key: str = "url_hash", columns: list[str] | None = None) -> DataFrame:
    """Requests joined with the entries that are younger than the TTL (an entry of exactly that age is expired)."""
    fresh = store.where(F.col("fetched_at") > now - ttl_seconds)
    return requests.join(fresh.select(key, *(columns or [c for c in fresh.columns if c != key])), key)


def upsert(log: DataFrame, *, key: str = "url_hash", seq: str = "seq", via: str = "via", force: str = "force") -> DataFrame:
    """What a store holds after the writes of ``log`` in the order of ``seq``.

    A write replaces the entry, unless the entry came from a browser, the write
    does not, and it is not forced. So from the last forced write on, the last
    browser write wins if there is one, else the last write: which it is shows from three
    maxima, so writes of one key are combined before they meet.
    """
    row, browser = F.struct(*log.columns), F.col(via) == BROWSER
    best = log.groupBy(key).agg(
        F.max(F.when(F.col(force), F.col(seq))).alias("_forced"),
        F.max_by(row, F.col(seq)).alias("_last"),
        F.max_by(row, F.when(browser, F.col(seq))).alias("_browser"),
    )
    stands = F.col("_browser").isNotNull() & (F.col("_forced").isNull() | (F.col(f"_browser.{seq}") >= F.col("_forced")))
    return best.select(F.when(stands, F.col("_browser")).otherwise(F.col("_last")).alias("_row")).select("_row.*")


def is_expired(fetched_at: Column, now: int, older_than_seconds: int) -> Column:
    return fetched_at <= now - older_than_seconds


def prune(pages: DataFrame, robots: DataFrame, *, older_than_seconds: int, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept pages, kept robots, one row with ``removed``); crawl logs are never pruned."""
    old = is_expired(F.col("fetched_at"), now, older_than_seconds)
    removed = pages.select(old.alias("old")).unionByName(robots.select(old.alias("old"))).agg(F.count_if("old").alias("removed"))
    return pages.where(~old), robots.where(~old), removed


def robots_files(cached: DataFrame, live: DataFrame, *, ttl_seconds: int, now: int) -> DataFrame:
    """``site, body, fetched_at``: young entries of the store, and for other sites the file that was fetched now."""
    young = cached.where(F.col("fetched_at") > now - ttl_seconds).groupBy("site").agg(F.max_by("body", "fetched_at").alias("body"), F.max("fetched_at").alias("fetched_at"))
    rest = live.select("site", "body", F.lit(now).cast("long").alias("fetched_at")).join(young, "site", "left_anti")
    return young.select("site", "body", F.col("fetched_at").cast("long").alias("fetched_at")).unionByName(rest)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the constructor of its paths."""
    jvm = spark._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def tables(spark: SparkSession, path: str) -> dict[str, str]:
    """Paths of a store's tables: ``pages``, ``robots`` and ``crawls`` in its folder, or the folder itself as pages."""
    path = path.rstrip("/")
    fs, make = _files(spark, path)
    own = {n: f"{path}/{n}" for n in ("pages", "robots", "crawls") if fs.exists(make(f"{path}/{n}"))}
    return own or {"pages": path}


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a folder."""
    fs, make = _files(spark, path)
    return fs.getContentSummary(make(path)).getLength()


def replace(rows: DataFrame, path: str) -> None:
    """Put ``rows`` (which may read the table itself) in the table's place.

    They are written beside it first, so a failed job leaves the old table; the two
    renames are atomic each on a file system, not in an object store.
    """
    path = path.rstrip("/")
    fs, make = _files(rows.sparkSession, path)
    mark = uuid.uuid4().hex
    new, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    rows.write.parquet(new)
    if not fs.rename(make(path), make(old)) or not fs.rename(make(new), make(path)):
        raise OSError(f"could not put {new} in the place of {path}")
    fs.delete(make(old), True)
    rows.sparkSession.catalog.refreshByPath(path)


def stats(**tables: DataFrame) -> DataFrame:
    """``name, n``: rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def log_crawls(log: DataFrame) -> DataFrame:
    """The last entry of each crawl id."""
    return log.groupBy("crawl_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "crawl_id"]), "seq").alias("_r")).select("crawl_id", "_r.*")
