"""Breadth-first traversal of a link graph, a level at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import shared_dir
from .frontier import Bucketed, Visited


def _cut(df: DataFrame) -> DataFrame:
    """Lineage ends at a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def bfs(edges: DataFrame, seeds: DataFrame, *, max_depth: int, key: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """``key, url, depth``: what is reached from the seeds by (src, dst) edges within ``max_depth`` steps.

    ``seeds`` may carry key columns, so that many crawls run at once; ``edges`` with a
    key column hold for that crawl alone, others for all.

    Edges are dealt out by their source once; a level then shuffles its frontier and what
    that leads to, never edges or visited rows.
    """
    keys = [*key, "url"]
    own = [k for k in key if k in edges.columns]
    spark = seeds.sparkSession
    ways = Bucketed(spark, [*own, "src"], buckets, "edges")
    visited = Visited(spark, keys, buckets, "visited")
    try:
        ways.append(edges.select(*own, "src", "dst"))
        frontier = visited.add_new(seeds, 0)
        for depth in range(1, max_depth + 1):
            step = frontier.select(*key, F.col("url").alias("src")).join(ways.rows(), [*own, "src"]).select(*key, F.col("dst").alias("url"))
            frontier = visited.add_new(step, depth)
            if frontier.isEmpty():
                break
        # Read by its path: the result outlives the table's name.
        return spark.read.schema(visited.rows().schema).parquet(visited.path).select(*keys, "depth")
    finally:
        ways.drop()
        visited.drop()


def outcome(pages: DataFrame) -> DataFrame:
    """``pages`` with what a crawl does with each: skipped_robots, error, skipped_type, skipped_shell or saved."""
    html = F.col("content_type").isin("text/html", "application/xhtml+xml", "")
    kind = (
        F.when(~F.col("allowed"), "skipped_robots")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("status") >= 400, "error")
        .when(~html, "skipped_type")
        .when(F.col("markdown").isNull() | F.col("shell"), "skipped_shell")
        .otherwise("saved")
    )
    reason = F.when(kind == "error", F.coalesce("error", F.col("status").cast("string")))
    return pages.withColumn("outcome", kind).withColumn("reason", reason)


def index(saved: DataFrame, *, max_pages: int, key: tuple[str, ...] = ()) -> DataFrame:
    """Saved pages numbered by (depth, url) within a crawl, with file names and index lines.

    Where the number of pages is bounded, the first in this order stay, whatever
    the order in which they were fetched.
    """
    if not key:  # no more than these rows meet in one task
        saved = saved.orderBy("depth", "url").limit(max_pages)
    w = Window.partitionBy(*key).orderBy("depth", "url")
    rows = saved.withColumn("number", F.row_number().over(w)).where(F.col("number") <= max_pages)
    digits = F.greatest(F.lit(3), F.length(F.col("number").cast("string")))
    name = F.concat(F.lpad(F.col("number").cast("string"), digits, F.lit("0")), F.lit("-"), T.slugify(F.col("title")), F.lit(".md"))
    rows = rows.withColumn("file", name).withColumn("tokens", T.estimate_tokens(F.col("markdown")))
    line = F.concat(T.pad(F.col("file"), 32), F.lit(" ~"), F.col("tokens").cast("string"), F.lit("tok  "), T.pad(F.col("title"), 28), F.lit(" "), F.col("path"))
    return rows.withColumn("line", line)


def totals(pages: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Saved, failed and skipped pages of each crawl."""
    return pages.groupBy(*key).agg(
        F.count_if(F.col("outcome") == "saved").alias("pages"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        F.count_if(F.startswith("outcome", F.lit("skipped"))).alias("skipped"),
    )


def front_matter(url, title, day, tokens):
    return F.concat(F.lit("---\nurl: "), url, F.lit("\ntitle: "), title, F.lit("\nfetched: "), day, F.lit("\ntokens: "), tokens.cast("string"), F.lit("\n---\n\n"))


def report(met: DataFrame, host: str, out_dir: str | None = None) -> DataFrame:
    """``section, pos, path, line`` of a crawl's summary: counts, folder, index lines, then errors."""
    t = totals(met)
    # The labels of the summary.
    head = F.concat(F.lit(f"crawl: {host}  pages: "), F.col("pages").cast("string"), F.lit("  errors: "), F.col("errors").cast("string"), F.lit("  skipped(robots/dupe/type): "), F.col("skipped").cast("string"))
    lines = [head] if out_dir is None else [head, F.lit(f"dir: {out_dir}")]
    top = t.select(F.posexplode(F.array(*lines)).alias("pos", "line")).select(F.lit(0).alias("section"), F.col("pos").cast("long").alias("pos"), F.lit("").alias("path"), "line")
    pages = met.where("outcome = 'saved'").select(F.lit(1).alias("section"), F.col("number").cast("long").alias("pos"), "path", "line")
    failed = met.where("outcome = 'error'").select(F.lit(2).alias("section"), F.lit(0).cast("long").alias("pos"), "path", F.concat(F.lit("errors: "), F.col("path"), F.lit(" ("), F.coalesce("reason", F.lit("")), F.lit(")")).alias("line"))
    return top.unionByName(pages).unionByName(failed)


def files(met: DataFrame, host: str, out_dir: str, day: str) -> DataFrame:
    """``file, content`` of a crawl's folder: each saved page under its number, INDEX.md and index.json.

    The two index files are one value each: they have a line for each of the
    ``max_pages`` saved and each failed page.
    """
    saved = met.where("outcome = 'saved'")
    pages = saved.select("file", F.concat(front_matter(F.coalesce("final_url", "url"), F.coalesce("title", F.lit("")), F.lit(day), F.col("tokens")), F.col("markdown")).alias("content"))
    line = F.array_sort(F.collect_list(F.struct("section", "pos", "path", "line")))
    index_md = report(met, host, out_dir).agg(F.concat(F.array_join(F.transform(line, lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")
    entry = F.concat(F.lit('  {\n    "url": '), text(F.coalesce("final_url", "url")), F.lit(',\n    "title": '), text(F.col("title")), F.lit(',\n    "file": '), text(F.col("file")), F.lit(',\n    "tokens": '), F.col("tokens").cast("string"), F.lit("\n  }"))
    entries = F.array_sort(F.collect_list(F.struct("number", entry.alias("entry"))))
    index_json = saved.agg(F.when(F.count(F.lit(1)) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(entries, lambda x: x["entry"]), ",\n"), F.lit("\n]"))).alias("content"))
    named = lambda df, name: df.select(F.lit(name).alias("file"), "content")
    return pages.unionByName(named(index_md, "INDEX.md")).unionByName(named(index_json, "index.json"))
