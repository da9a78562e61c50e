"""The same operators over a stream of responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.urls import url_hash
from ..operators import page_store, scrape


def read_responses(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def judged(responses: DataFrame) -> DataFrame:
    """Outcomes of responses; works on batch and stream alike."""
    return scrape.outcomes(scrape.with_extraction(scrape.normalise_responses(responses)))


def upsert_stream(responses: DataFrame, path: str, checkpoint: str, *, name: str = "responses", buckets: int = 64):
    """Keep a store of the winning write of each URL, in the order of ``seq``; a batch writes only the buckets of its URLs.

    The store remembers the stream's last batch, so a batch that is handed over again changes nothing.
    """
    columns = [f for f in responses.schema.fields if f.name != "url_hash"]
    schema = ", ".join(["url_hash string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)])

    def fold(batch: DataFrame, batch_id: int) -> None:
        held = page_store.KeyedStore(batch.sparkSession, path, schema, "url_hash", order="seq", fold=page_store.browser_first, buckets=buckets)
        held.put(batch.withColumn("url_hash", url_hash(F.col("url"))), force="force", stream=(name, batch_id))

    return responses.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return page_store.KeyedStore(spark, path, schema, "url_hash").read()


class _Expiry(StatefulProcessor):
    """Holds when a key was fetched last; a timer gives the key out when that is as old as the TTL."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.fetched = handle.getValueState("fetched_at", "fetched_at long")

    def handleInputRows(self, key, rows, timerValues):
        newest = max(int(t) for part in rows for t in part["fetched_at"])
        if self.fetched.exists():
            newest = max(newest, self.fetched.get()[0])
        self.fetched.update((newest,))
        self.handle.registerTimer((newest + self.ttl) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # A fetch that came later has a timer of its own.
        if self.fetched.exists() and (self.fetched.get()[0] + self.ttl) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            (fetched_at,) = self.fetched.get()
            self.fetched.clear()
            yield pd.DataFrame({"url": [key[0]], "fetched_at": [fetched_at]})

    def close(self) -> None:
        pass


def expired_keys(responses: DataFrame, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """``url, fetched_at``: URLs of a stream as their last fetch gets as old as the TTL, by the stream's own clock.

    Needs the RocksDB state store, as all processors with timers do.
    """
    seen = responses.where("url IS NOT NULL AND fetched_at IS NOT NULL").select("url", "fetched_at", F.timestamp_seconds("fetched_at").alias("at")).withWatermark("at", late)
    return seen.groupBy("url").transformWithStateInPandas(_Expiry(ttl_seconds), outputStructType="url string, fetched_at long", outputMode="Append", timeMode="EventTime")


def hourly_outcomes(judgements: DataFrame, time_col: str = "fetched_time", late: str = "2 hours") -> DataFrame:
    """Outcomes by hour of event time; rows later than the watermark are dropped by the stream."""
    return judgements.withWatermark(time_col, late).groupBy(F.window(time_col, "1 hour").alias("hour"), "outcome").agg(F.count(F.lit(1)).alias("n"))
