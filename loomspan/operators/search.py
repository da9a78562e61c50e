"""Search over a corpus by an inverted index with BM25, and the compact list of its hits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import once
from ..session import shared_dir

#: Words of texts and queries: runs of letters and digits, in lower case.
WORD = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75
#: Scores are compared after rounding, so that the order of a sum decides no rank.
DIGITS = 9
#: Rows that one task sorts or adds up; with more rows there are more tasks.
TASK_ROWS = 1 << 20
#: Rows of the queries' words, one for each part of the documents, that are sent to the postings; more are joined by a shuffle.
SENT = 1 << 18


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


class Index:
    """Postings (term, id, tf, n_words) in buckets by the hash of their term, in files sorted by term.

    A query reads the buckets of its own terms alone, and in them the row groups that
    hold these terms. ``n_docs`` and ``n_words`` are those of the corpus when the index was written.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, n_docs: int, n_words: int):
        self.spark, self.path, self.buckets, self.n_docs, self.n_words = spark, path, buckets, n_docs, n_words

    @classmethod
    def write(cls, docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> Index:
        """Index the words of ``docs``; a null or wordless text counts as a document without words."""
        spark = docs.sparkSession
        path = (path or f"{shared_dir(spark)}/loomspan/index-{uuid.uuid4().hex}").rstrip("/")
        own = docs.select(F.col(id_col).alias("id"), once(F.sort_array(words(F.col(text_col)))).alias("words"))
        # A document's distinct words and where the run of each ends in their order: so occurrences are counted within the row.
        ends = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.coalesce(F.get("words", x["i"] + 1) != x["w"], F.lit(True)))
        runs = own.select("id", F.size("words").alias("n_words"), once(ends).alias("ends"))
        tf = F.transform("ends", lambda x, k: F.struct(x["w"].alias("term"), (x["i"] - F.coalesce(F.get("ends", k - 1)["i"], F.lit(-1))).alias("tf")))
        counts = runs.select("id", "n_words", F.inline(tf))
        total = own.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum(F.size("words")), F.lit(0)).cast("long").alias("n_words"))
        total.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/totals")  # one row
        # A bucket is cut into slices of its documents, so that no task's rows grow with the corpus, even those of one term.
        slices = -(-max(1, spark.read.parquet(f"{path}/totals").first().n_words) // (buckets * TASK_ROWS))
        bucket, part = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(slices))
        dealt = counts.withColumn("bucket", bucket).repartition(buckets * slices, "bucket", part).sortWithinPartitions("bucket", "term", "id")
        dealt.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        return cls.open(spark, path, docs.schema[id_col].dataType.simpleString())

    @classmethod
    def open(cls, spark: SparkSession, path: str, id_type: str = "bigint") -> Index:
        path = path.rstrip("/")
        r = spark.read.parquet(f"{path}/totals").first()
        out = cls(spark, path, r.buckets, r.n_docs, r.n_words)
        out.schema = f"id {id_type}, n_words int, term string, tf int, bucket int"
        return out

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """All postings, or those of some terms, from these terms' buckets."""
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/postings")
        if terms is None:
            return rows
        if not terms:
            return rows.limit(0)
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")).collect()
        return rows.where(F.col("bucket").isin(sorted({r.bucket for r in asked})) & F.col("term").isin(terms))

    def weight(self, df: Column) -> Column:
        """A term's weight by the number of documents that have it."""
        return F.log1p((F.lit(float(self.n_docs)) - df + 0.5) / (df + 0.5))

    def score(self, tf: Column, n_words: Column, weight: Column) -> Column:
        mean = max(self.n_words / self.n_docs, 1e-9) if self.n_docs else 1.0
        return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_words / mean))

    def search(self, query: str, max_results: int = 8) -> DataFrame:
        """``id, hits, score, rank`` of the best documents for a query's words; hits are their occurrences."""
        terms = list(dict.fromkeys(self.spark.range(1).select(words(F.lit(query)).alias("w")).first().w))
        found = self.postings(terms)
        weights = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", self.weight(F.col("df")).alias("weight"))
        scored = found.join(F.broadcast(weights), "term")  # a row a word of the query
        total = scored.groupBy("id").agg(F.sum("tf").alias("hits"), F.round(F.sum(self.score(F.col("tf"), F.col("n_words"), F.col("weight"))), DIGITS).alias("score"))
        top = total.orderBy(F.desc("score"), "id").limit(max_results)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # max_results rows

    def search_many(self, queries: DataFrame, *, query_id: str = "query_id", text: str = "text", max_results: int = 8, salts: int = 32) -> DataFrame:
        """``query_id, id, score, rank`` for a table of queries, all at once.

        Postings are joined with the queries by term and one of ``salts`` parts of the documents (more in a large corpus),
        so a common term's postings meet its queries in as many tasks, and the queries' rows are repeated ``salts`` times.
        Few of them are sent to the postings. The queries' words and their weights are written first, so the number of
        scores is known, and as many tasks add them up as keep each at some TASK_ROWS.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
        terms = asked.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        df = self.postings().join(terms, ["bucket", "term"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        path = f"{shared_dir(self.spark)}/loomspan/asked-{uuid.uuid4().hex}"
        asked.join(df, "term").withColumn("weight", self.weight(F.col("df"))).write.parquet(path)
        asked = self.spark.read.schema(f"query_id {queries.schema[query_id].dataType.simpleString()}, term string, df long, weight double").parquet(path)
        size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("scores")).first()
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(least, -(-size.scores // TASK_ROWS))
        salts = max(salts, -(-self.n_docs // TASK_ROWS))
        own = asked.select("query_id", "term", "weight").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = self.postings().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        if size.n * salts <= SENT:
            own = F.broadcast(own)
        else:
            found = found.join(terms, ["bucket", "term"], "left_semi").repartition(max(least, -(-self.n_words // TASK_ROWS)), "term", "salt")
        met = found.join(own, ["term", "salt"])
        scored = met.select("query_id", "id", self.score(F.col("tf"), F.col("n_words"), F.col("weight")).alias("s")).repartition(tasks, "query_id", "id")
        total = scored.groupBy("query_id", "id").agg(F.round(F.sum("s"), DIGITS).alias("score"))
        ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
        return ranked.where(F.col("rank") <= max_results)


def search(docs: DataFrame, terms: list[str], *, id_col: str = "doc_id", text_col: str = "text", max_results: int = 8) -> DataFrame:
    """``id, hits, rank``: documents by the number of occurrences of the terms anywhere in their text, the most first.

    A scan for tables that are searched once; ``Index`` is for those that are searched often.
    """
    low = F.lower(F.coalesce(text_col, F.lit("")))
    hits = F.lit(0)
    for t in terms:
        t = t.lower()
        hits = hits + ((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("int")
    top = docs.select(F.col(id_col).alias("id"), hits.cast("long").alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(max_results)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "id")))  # max_results rows


def result_line(rank: Column, title: Column, href: Column, url: Column, body: Column) -> Column:
    """A numbered hit with its snippet below."""
    where = F.when(F.coalesce(href, F.lit("")) != "", href).otherwise(F.coalesce(url, F.lit("")))
    short = T.snippet(body)
    head = F.concat(rank.cast("string"), F.lit(". "), F.coalesce(title, F.lit("(untitled)")), F.lit(" — "), where)
    return F.concat_ws("\n", head, F.when(short != "", F.concat(F.lit("   "), short)))
