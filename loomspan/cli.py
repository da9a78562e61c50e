"""Command line: ``python -m loomspan.cli VERB ...`` over a Parquet table of responses.

    scrape  RESPONSES URL...   [--max-length N] [--raw] [--links] [--fresh] [--cache PATH] [--home FOLDER]
    extract RESPONSES URL...   [--types json-ld,tables] [--max-rows N] [--home FOLDER]
    map     RESPONSES URL      [--max-urls N] [--search S] [--no-sitemap] [--subdomains]
    crawl   RESPONSES URL      [--max-pages N] [--max-depth N] [--include GLOB]... [--exclude GLOB]... [--out FOLDER] [--home FOLDER]
    search  DOCUMENTS QUERY    [--max-results N]
    cache   stats|prune|clear PATH [--days N] [--out PATH]

With ``--home`` (or LOOMSPAN_HOME) young pages and robots files come from that folder's store, and
what had to be fetched goes into it; ``--cache`` is a table that is read only.
"""

from __future__ import annotations

import argparse
import time
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import crawl, page_store, store
from .sources import sink


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspan")
    verbs = p.add_subparsers(dest="verb", required=True)
    s = verbs.add_parser("scrape")
    s.add_argument("table"), s.add_argument("urls", nargs="+"), s.add_argument("--max-length", type=int, default=8000), s.add_argument("--cache")
    s.add_argument("--home", default=api.home_folder())
    for flag in ("--raw", "--links", "--fresh"):
        s.add_argument(flag, action="store_true")
    e = verbs.add_parser("extract")
    e.add_argument("table"), e.add_argument("urls", nargs="+"), e.add_argument("--types", default="json-ld,opengraph,microdata,tables"), e.add_argument("--max-rows", type=int, default=100), e.add_argument("--home", default=api.home_folder())
    m = verbs.add_parser("map")
    m.add_argument("table"), m.add_argument("url"), m.add_argument("--max-urls", type=int, default=200), m.add_argument("--search")
    m.add_argument("--no-sitemap", action="store_true"), m.add_argument("--subdomains", action="store_true")
    c = verbs.add_parser("crawl")
    c.add_argument("table"), c.add_argument("url"), c.add_argument("--max-pages", type=int, default=30), c.add_argument("--max-depth", type=int, default=2)
    c.add_argument("--include", action="append"), c.add_argument("--exclude", action="append"), c.add_argument("--out"), c.add_argument("--subdomains", action="store_true"), c.add_argument("--home", default=api.home_folder())
    q = verbs.add_parser("search")
    q.add_argument("table"), q.add_argument("query"), q.add_argument("--max-results", type=int, default=8)
    k = verbs.add_parser("cache")
    k.add_argument("action", choices=["stats", "prune", "clear"]), k.add_argument("table"), k.add_argument("--days", type=int, default=30), k.add_argument("--out")
    return p


def run(spark: SparkSession, argv: list[str]) -> list[str]:
    a = parser().parse_args(argv)
    if a.verb == "cache":
        return _cache(spark, a)
    table, settings, now = spark.read.parquet(a.table), api.Settings.from_environment(), int(time.time())
    home = page_store.Home(spark, a.home) if getattr(a, "home", None) else None
    if a.verb == "scrape":
        asked = spark.createDataFrame([(u,) for u in a.urls], "url string")
        cache = spark.read.parquet(a.cache) if a.cache else None
        how = {"raw": a.raw, "fresh": a.fresh, "include_links": a.links, "max_length": a.max_length, "now": now, "settings": settings}
        rows = api.scrape_and_store(asked, table, home, **how) if home else api.scrape(asked, table, cache=cache, **how)
        return [r.report for r in rows.orderBy("url").collect()]
    if a.verb == "extract":
        asked = spark.createDataFrame([(u,) for u in a.urls], "url string")
        how = {"types": tuple(a.types.split(",")), "max_rows": a.max_rows, "now": now, "settings": settings}
        rows = api.extract_and_store(asked, table, home, **how) if home else api.extract(asked, table, **how)
        return [r.data for r in rows.orderBy("url").collect()]
    if a.verb == "map":
        rows = api.map_site(table, a.url, max_urls=a.max_urls, search=a.search, use_sitemap=not a.no_sitemap, include_subdomains=a.subdomains)
        line = api.map_summary(table, a.url, max_urls=a.max_urls, search=a.search, use_sitemap=not a.no_sitemap, include_subdomains=a.subdomains).first().line
        return [line, *[r.display for r in rows.collect()]]
    if a.verb == "crawl":
        limits = {"max_pages": a.max_pages, "max_depth": a.max_depth, "include": a.include, "exclude": a.exclude, "subdomains": a.subdomains, "now": now, "settings": settings}
        met = api.crawl_and_store(table, a.url, home, out_dir=a.out, **limits) if home else api.crawl(table, a.url, **limits)
        host = urlsplit(a.url).netloc.lower()
        if a.out:
            met = crawl._cut(met)
            sink.write_files(crawl.files(met, host, a.out, time.strftime("%Y-%m-%d")), a.out)
        return [r.line for r in crawl.report(met, host, a.out).orderBy("section", "pos", "path").collect()]
    return [r.line for r in api.search(table, a.query, max_results=a.max_results).orderBy("rank").collect()] or [f"no results for: {a.query}"]


def _cache(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    """Counts of a store, or a store without its old rows or any; with ``--out`` the rows that stay go there instead."""
    if page_store.Home.is_one(spark, a.table) and not a.out:
        home = page_store.Home(spark, a.table)
        if a.action == "stats":
            return [*(f"{n}: {c}" for n, c in home.counts().items()), f"bytes: {store.size(spark, a.table)}"]
        removed = home.clear() if a.action == "clear" else home.prune(a.days * 86_400, int(time.time()))
        for t in home.tables.values():
            t.vacuum()
        return [f"{removed} rows removed"]
    paths = store.tables(spark, a.table)
    rows = {name: spark.read.parquet(path) for name, path in paths.items()}
    if a.action == "stats":
        return [*[f"{r.name}: {r.n}" for r in store.stats(**rows).collect()], f"bytes: {sum(store.size(spark, p) for p in paths.values())}"]
    old = F.lit(True) if a.action == "clear" else store.is_expired(F.col("fetched_at"), int(time.time()), a.days * 86_400)
    touched = [n for n in rows if a.action == "clear" or n != "crawls"]
    removed = sum(rows[n].where(old).count() for n in touched)
    for n in touched:
        if not a.out:
            store.replace(rows[n].where(~old), paths[n])
        else:
            rows[n].where(~old).write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{n}" if len(paths) > 1 else a.out)
    return [f"{removed} rows removed" + (f"; kept rows in {a.out}" if a.out else "")]


def main() -> None:
    from .session import local_session

    import sys

    print("\n".join(run(local_session(), sys.argv[1:])))


if __name__ == "__main__":
    main()
