"""What a level-by-level traversal looks up again and again, as bucketed tables.

A bucketed table is dealt out by the hash of its key when it is written, so a join with it
shuffles the other side alone. A traversal writes its edges (or fetched pages) once, and what
it has visited level by level; each level then moves no more rows than its own frontier
and what that leads to. Files lie in the shared folder; tables are dropped from the session's
catalog when the traversal is done, and their files stay, as results may read them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import shared_dir

#: A frontier of so many keys is asked for by name, so that only its buckets are read.
NAMED_KEYS = 500


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as a shuffle has partitions; with fewer, Catalyst would shuffle both sides."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return int(first or spark.conf.get("spark.sql.shuffle.partitions"))


class Bucketed:
    """A table that grows by appending, bucketed and sorted by its keys."""

    def __init__(self, spark: SparkSession, keys: list[str], buckets: int | None = None, name: str = "bucketed"):
        self.spark, self.keys = spark, keys
        self.buckets = buckets or default_buckets(spark)
        self.name = f"loomspan_{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/loomspan/{self.name}"

    def append(self, rows: DataFrame) -> None:
        dealt = rows.repartition(self.buckets, *self.keys)  # one file a bucket; no exchange where rows are dealt so already
        writer = dealt.write.bucketBy(self.buckets, self.keys[0], *self.keys[1:]).sortBy(self.keys[0], *self.keys[1:])
        writer.option("path", self.path).mode("append").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


class Visited(Bucketed):
    """The keys that a traversal has met."""

    def add_new(self, step: DataFrame, depth: int) -> DataFrame:
        """Of ``step`` the keys not met before, once each, without null URLs: appended with their depth and given back as they were written."""
        new = step.select(*self.keys).where(F.col(self.keys[-1]).isNotNull())
        if depth:
            new = new.join(self.rows().select(*self.keys), self.keys, "left_anti")
        self.append(new.distinct().withColumn("depth", F.lit(depth)))
        self.spark.catalog.refreshTable(self.name)
        return self.rows().where(F.col("depth") == depth)


class Web(Bucketed):
    """Fetched pages by canonical URL, each once, as a crawl looks them up."""

    @classmethod
    def write(cls, responses: DataFrame, buckets: int | None = None) -> Web:
        """Deal ``responses`` out by URL; of several for a URL one stays."""
        web = cls(responses.sparkSession, ["url"], buckets, "web")
        by_url = responses.withColumn("url", U.once(U.normalize_url(F.col("url")))).where(F.col("url").isNotNull())
        web.append(by_url.repartition(web.buckets, "url").dropDuplicates(["url"]))
        return web

    def lookup(self, asked: DataFrame, n: int) -> DataFrame:
        """``asked`` (n rows with a ``url``) with the pages' columns, null where there is no page."""
        pages = self.rows()
        if n <= NAMED_KEYS:
            urls = [r.url for r in asked.select("url").distinct().limit(NAMED_KEYS + 1).collect()]
            pages = pages.where(F.col("url").isin(urls))
        return asked.join(pages, "url", "left")
