"""The verbs: scrape, crawl, map, search and extract over tables of responses.

A table of responses (url, final_url, status, content_type, html, via, error)
stands for the web: a corpus of fetched pages, a stream, or the live source.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import guards as G
from .functions import text as T
from .functions import urls as U
from .operators import crawl as C
from .operators.frontier import Visited, Web
from .operators import dom, links, page_store, robots, scrape as S, search as Q, store
from .operators.page_store import Home


@dataclass(frozen=True)
class Settings:
    """Limits and names; every call takes its own."""

    user_agent: str = "loomspan/1.0"
    page_ttl_seconds: int = 7 * 86_400
    robots_ttl_seconds: int = 86_400
    max_body_bytes: int = S.MAX_BODY_BYTES
    delay_seconds: float = 1.0
    timeout_seconds: float = 20.0

    @classmethod
    def from_environment(cls) -> Settings:
        """LOOMSPAN_UA, LOOMSPAN_TTL (of pages, in seconds) and LOOMSPAN_DELAY, read on each call."""
        given = {"user_agent": ("LOOMSPAN_UA", str), "page_ttl_seconds": ("LOOMSPAN_TTL", int), "delay_seconds": ("LOOMSPAN_DELAY", float)}
        return cls(**{field: kind(os.environ[name]) for field, (name, kind) in given.items() if name in os.environ})


def home_folder() -> str | None:
    """The folder of the verbs' tables, where the environment names one (LOOMSPAN_HOME)."""
    return os.environ.get("LOOMSPAN_HOME")


def scrape(
    requests: DataFrame,
    responses: DataFrame,
    *,
    cache: DataFrame | None = None,
    rendered: DataFrame | None = None,
    now: int = 0,
    raw: bool = False,
    fresh: bool = False,
    include_links: bool = False,
    max_length: int = 8000,
    settings: Settings = Settings(),
) -> DataFrame:
    """``url, outcome, from_cache, report, body, title`` for each requested url.

    Young cache entries answer unless ``fresh``; an entry that proves a wall is
    fetched anew. What is missing there is joined from the responses; a rendering
    that extracts more replaces a response.
    """
    asked = requests.select("url").distinct().withColumn("url_hash", U.url_hash(F.col("url")))
    columns = ["final_url", "status", "content_type", "html", "via", "error"]
    live = responses.withColumn("url_hash", U.url_hash(F.col("url"))).drop("url").dropDuplicates(["url_hash"])
    rows = asked.join(live.select("url_hash", *columns), "url_hash", "left").withColumn("from_cache", F.lit(False)).withColumn("fetched_at", F.lit(None).cast("long"))
    if cache is not None and not fresh:
        kept = cache.where(F.col("html").isNotNull()).select("url_hash", "final_url", "status", "content_type", "html", "via", "fetched_at")
        hit = store.ttl_read(asked, kept, ttl_seconds=settings.page_ttl_seconds, now=now).withColumn("error", F.lit(None).cast("string")).withColumn("from_cache", F.lit(True))
        judged = S.outcomes(S.with_extraction(hit, include_links), raw=raw)
        good = judged.where(F.col("outcome").isin("content", "raw")).select("url_hash")
        walled = judged.where(F.col("quality.consent_wall") | F.col("quality.block_wall")).select("url_hash", F.lit(True).alias("replaces"))
        hit = hit.join(good, "url_hash", "left_semi")
        rows = rows.join(good, "url_hash", "left_anti").unionByName(hit.select(*rows.columns)).join(walled, "url_hash", "left")
    else:
        rows = rows.withColumn("replaces", F.lit(False))
    rows = rows.withColumn("replaces", F.coalesce("replaces", F.lit(False)))
    if rendered is not None:
        own = lambda name, kind: (F.col(name) if name in rendered.columns else F.lit(None)).cast(kind)
        shots = rendered.withColumn("url_hash", U.url_hash(F.col("url"))).select("url_hash", F.col("html").alias("r_html"), F.col("final_url").alias("r_url"), F.coalesce(own("status", "int"), F.lit(200)).alias("r_status"), own("error", "string").alias("r_error")).dropDuplicates(["url_hash"])
        # a challenge at 403 or 503 is for a browser to pass: its rendering stands in for the response
        passed = ~F.col("from_cache") & F.col("status").isin(403, 503) & G.is_challenge(F.col("html")) & F.col("r_html").isNotNull() & F.col("r_error").isNull()
        rows = rows.join(shots, "url_hash", "left").withColumn("passed", F.coalesce(passed, F.lit(False)))
        instead = {"html": F.col("r_html"), "final_url": F.col("r_url"), "status": F.col("r_status"), "content_type": F.lit("text/html"), "via": F.lit(store.BROWSER)}
        rows = rows.withColumns({c: F.when(F.col("passed"), v).otherwise(F.col(c)) for c, v in instead.items()})
    missing = F.col("status").isNull() & F.col("error").isNull()
    rows = rows.withColumn("error", F.when(missing, "no response").otherwise(F.col("error"))).withColumn("status", F.coalesce("status", F.lit(0))).withColumn("final_url", F.coalesce("final_url", "url"))
    rows = S.with_extraction(S.normalise_responses(rows, settings.max_body_bytes), include_links)
    if rendered is not None and not raw:
        rows = rows.withColumn("r_parsed", dom.parsed(F.col("r_html"), include_links=include_links))
        more = ~F.col("from_cache") & ~F.col("passed") & F.col("error").isNull() & (F.coalesce(F.length("r_parsed.markdown"), F.lit(-1)) > F.coalesce(F.length("parsed.markdown"), F.lit(-1)))
        more = more & (G.needs_render(F.col("html"), F.col("parsed.markdown")) | F.col("parsed.markdown").isNull() | (F.length("parsed.markdown") < G.SHELL_TEXT_FLOOR))
        more = F.coalesce(more, F.lit(False))
        rows = rows.withColumn("more", more)
        rows = rows.withColumns({"html": F.when(F.col("more"), F.col("r_html")).otherwise(F.col("html")), "parsed": F.when(F.col("more"), F.col("r_parsed")).otherwise(F.col("parsed")), "final_url": F.when(F.col("more"), F.col("r_url")).otherwise(F.col("final_url")), "via": F.when(F.col("more"), F.lit(store.BROWSER)).otherwise(F.col("via"))})
    out = S.outcomes(rows, raw=raw)
    label = F.when(F.col("from_cache"), F.concat(F.lit("cache "), F.date_format(F.timestamp_seconds("fetched_at"), "yyyy-MM-dd"))).otherwise(F.lit("live"))
    label = F.concat(label, F.lit(" | via: "), F.col("via"), F.lit(" | raw" if raw else ""))
    words = F.transform("quality.warnings", G.warning_text)
    body = F.when(F.col("outcome") == "json", dom.pretty_json(F.when(F.col("outcome") == "json", F.col("html")))).otherwise(F.col("body"))
    out = out.withColumn("body", body)
    report = F.when(F.col("body").isNotNull(), S.report(F.col("final_url"), F.col("title"), label, F.col("body"), words, max_length)).otherwise(refusal(F.col("outcome"), F.col("url"), F.col("final_url"), F.col("status"), F.col("error"), F.col("content_type")))
    return out.withColumn("report", report).select("url", "url_hash", "outcome", "from_cache", "report", "body", "title", "html", "final_url", "status", "content_type", "via", "quality", "replaces")


def scrape_and_store(requests: DataFrame, responses: DataFrame, home: Home, *, now: int, settings: Settings = Settings(), **how) -> DataFrame:
    """``scrape`` on the store: young pages answer from it, and pages that had to be fetched go into it.

    Walls, shells, errors and raw texts are never stored. A stored wall that made a page be fetched again is
    replaced whatever its source.
    """
    asked = requests.select(U.url_hash(F.col("url")).alias("url_hash"))
    cache = home.pages.lookup(asked, settings.page_ttl_seconds, now)
    rows = C._cut(scrape(requests, responses, cache=cache, now=now, settings=settings, **how))
    fetched = rows.where(~F.col("from_cache") & F.col("outcome").isin("content", "pdf"))
    home.put_pages(fetched.withColumn("markdown", F.col("body")), now, force="replaces")
    return rows


def refusal(outcome: Column, url: Column, final_url: Column, status: Column, error: Column, content_type: Column) -> Column:
    """What a reader is told in place of content."""
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return (
        F.when(outcome == "fetch_error", said("error fetching ", url, ": ", error))
        .when(outcome == "http_error", said("error fetching ", url, ": HTTP ", status.cast("string")))
        .when(outcome.isin("blocked_raw", "blocked_extracted"), said("blocked by bot protection (final url: ", final_url, ")"))
        .when(outcome == "consent_wall", said("consent/cookie wall (final url: ", final_url, ")"))
        .when(outcome == "pdf_failed", said("could not extract text from PDF at ", url))
        .when(outcome == "unsupported", said("unsupported content type '", content_type, "' at ", url))
        .when(outcome == "raw_empty", said("no text found at ", final_url))
        .otherwise(said("JavaScript app shell: no content without rendering (url: ", final_url, ")"))
    )


KINDS = ("json-ld", "opengraph", "microdata", "tables")


def extract(requests: DataFrame, responses: DataFrame, *, cache: DataFrame | None = None, now: int = 0, types: tuple[str, ...] = KINDS, max_rows: int = 100, settings: Settings = Settings()) -> DataFrame:
    """``url, data``: JSON of the structured data of each requested page, or of its error; young cache entries answer first."""
    return _extracted(requests, responses, cache, now, types, max_rows, settings).select("url", "data")


def _extracted(requests, responses, cache, now, types, max_rows, settings) -> DataFrame:
    asked = requests.select("url").distinct().withColumn("url_hash", U.url_hash(F.col("url")))
    live = responses.withColumn("url_hash", U.url_hash(F.col("url"))).drop("url").dropDuplicates(["url_hash"])
    columns = ["final_url", "status", "content_type", "html", "via", "error"]
    rows = asked.join(live.select("url_hash", *columns), "url_hash", "left").withColumn("from_cache", F.lit(False))
    if cache is not None:
        kept = cache.where("html IS NOT NULL").withColumn("error", F.lit(None).cast("string")).select("url_hash", "fetched_at", *columns)
        hit = store.ttl_read(asked, kept, ttl_seconds=settings.page_ttl_seconds, now=now).withColumn("from_cache", F.lit(True))
        rows = rows.join(hit.select("url_hash"), "url_hash", "left_anti").unionByName(hit.select(*rows.columns))
    bad = F.when(F.col("status").isNull(), F.lit("no response")).when(F.col("error").isNotNull(), F.col("error")).when(~F.col("from_cache") & (F.col("status") >= 400), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    rows = rows.withColumn("bad", bad).withColumn("parsed", dom.parsed(F.when(F.col("bad").isNull(), F.col("html")), max_rows))
    data = F.when(F.col("bad").isNotNull(), F.to_json(F.struct("url", F.col("bad").alias("error")))).otherwise(S.structured(F.col("parsed"), F.coalesce("final_url", "url"), types))
    return rows.withColumn("data", data)


def extract_and_store(requests: DataFrame, responses: DataFrame, home: Home, *, now: int, types: tuple[str, ...] = KINDS, max_rows: int = 100, settings: Settings = Settings()) -> DataFrame:
    """``extract`` on the store: pages that had to be fetched go into it, without a main text, as none was judged."""
    asked = requests.select(U.url_hash(F.col("url")).alias("url_hash"))
    cache = home.pages.lookup(asked, settings.page_ttl_seconds, now)
    rows = C._cut(_extracted(requests, responses, cache, now, types, max_rows, settings).drop("parsed"))
    none = F.lit(None).cast("string")
    home.put_pages(rows.where("bad IS NULL AND NOT from_cache").withColumns({"markdown": none, "title": none}), now)
    return rows.select("url", "data")


def map_site(responses: DataFrame, url: str, *, max_urls: int = 200, search: str | None = None, use_sitemap: bool = True, include_subdomains: bool = False) -> DataFrame:
    """``url, source, display`` of a site: its sitemap's locations, then the links of the page."""
    return links.map_urls(_candidates(responses, url, max_urls, use_sitemap), url, search=search, max_urls=max_urls, include_subdomains=include_subdomains)


def map_summary(responses: DataFrame, url: str, *, max_urls: int = 200, search: str | None = None, use_sitemap: bool = True, include_subdomains: bool = False) -> DataFrame:
    """One row ``line``: what ``map_site`` found, by source."""
    return links.map_summary(_candidates(responses, url, max_urls, use_sitemap), url, search=search, max_urls=max_urls, include_subdomains=include_subdomains)


def map_sites(responses: DataFrame, starts: DataFrame, *, max_urls: int = 200, use_sitemap: bool = True, include_subdomains: bool = False) -> DataFrame:
    """``site, rank, url, source``: the maps of all sites whose ``url`` is in ``starts``, at once."""
    return links.map_sites(_site_candidates(responses, starts, max_urls, use_sitemap), max_urls=max_urls, include_subdomains=include_subdomains)


def _candidates(responses: DataFrame, url: str, max_urls: int, use_sitemap: bool) -> DataFrame:
    """``source, pos, url`` of a site's sitemap and of the links of its page."""
    return _site_candidates(responses, responses.sparkSession.createDataFrame([(url,)], "url string"), max_urls, use_sitemap).drop("site")


def _site_candidates(responses: DataFrame, starts: DataFrame, max_urls: int, use_sitemap: bool) -> DataFrame:
    """``site, source, pos, url``; a site is the start's URL as it was given."""
    good = responses.where((F.col("status") == 200) & F.col("html").isNotNull())
    url = F.col("url")
    root = F.concat(U.scheme(url), F.lit("://"), U.netloc(url))
    here = starts.where(url.isNotNull()).select("url").distinct().select(url.alias("site"), U.normalize_url(url).alias("page"), root.alias("root"), F.regexp_replace(U.path(url), "/+$", "").alias("way"))
    pages = good.withColumn("page", U.normalize_url(url)).join(here.select("site", "page"), "page").withColumn("base", F.coalesce("final_url", "url"))
    parts = [links.extract_links(pages, base="base", keys=("site",)).select("site", F.lit("links").alias("source"), F.col("pos").cast("long").alias("pos"), F.col("link").alias("url"))]
    if use_sitemap:
        # The root's sitemap, then that of the start's path: the first with a location counts.
        places = F.array(F.struct(F.lit(0).alias("nth"), F.concat("root", F.lit("/sitemap.xml")).alias("url")), F.struct(F.lit(1).alias("nth"), F.concat("root", "way", F.lit("/sitemap.xml")).alias("url")))
        asked = here.select("site", "way", F.explode(places).alias("p")).where("p.nth = 0 OR way <> ''").select("site", "p.nth", "p.url")
        maps = good.select("url", "html").join(asked, "url").select("site", "nth", dom.sitemap_locs(F.col("html")).alias("m")).where(F.size("m.locs") > 0)
        locs = maps.groupBy("site").agg(F.min_by("m", "nth").alias("m")).select("site", "m.is_index", F.posexplode("m.locs").alias("pos", "url"))
        parts.append(locs.where("NOT is_index").select("site", F.lit("sitemap").alias("source"), F.col("pos").cast("long").alias("pos"), "url"))
        kids = good.select("url", "html").join(locs.where("is_index AND pos < 20").select("site", "pos", "url"), "url").select("site", "pos", dom.sitemap_locs(F.col("html"))["locs"].alias("locs"))
        kids = links.child_sitemaps(kids, max_urls, key=("site",))
        parts.append(kids.select("site", F.col("pos").alias("kid"), F.posexplode("locs").alias("i", "url")).select("site", F.lit("sitemap").alias("source"), (F.col("kid").cast("long") * 1_000_000 + F.col("i")).alias("pos"), "url"))
    return reduce(DataFrame.unionByName, parts)


def crawl(
    responses: DataFrame | Web,
    start: str,
    *,
    max_pages: int = 30,
    max_depth: int = 2,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    subdomains: bool = False,
    robots_cache: DataFrame | None = None,
    now: int = 0,
    settings: Settings = Settings(),
) -> DataFrame:
    """``url, depth, outcome, reason, title, markdown, html, path`` of what a crawl meets, level by level.

    ``responses`` are dealt out by URL once; a ``Web`` that was written before serves many crawls. A level
    reads the buckets that hold its frontier, and shuffles no responses. Pages are taken in the order of (depth, url) until ``max_pages`` are saved.
    Robots files are responses for ``<site>/robots.txt``; a young entry (site, body,
    fetched_at) of ``robots_cache`` goes before them.
    """
    own = not isinstance(responses, Web)
    web = Web.write(responses) if own else responses
    spark = web.spark
    visited = Visited(spark, ["url"], web.buckets, "visited")
    try:
        return _crawl(spark, web, visited, start, max_pages, max_depth, include, exclude, subdomains, robots_cache, now, settings)
    finally:
        visited.drop()
        if own:
            web.drop()


def crawl_and_store(responses: DataFrame | Web, start: str, home: Home, *, now: int, out_dir: str | None = None, settings: Settings = Settings(), **limits) -> DataFrame:
    """``crawl`` on the store: young robots entries answer, and the pages saved, robots files read and the crawl itself go into it."""
    web = responses if isinstance(responses, Web) else Web.write(responses)
    met = C._cut(crawl(web, start, robots_cache=home.robots.read(), now=now, settings=settings, **limits))
    saved = met.where("outcome = 'saved'")
    home.put_pages(saved, now)
    files = _robots_files(web, met.select("url"), home.robots.read(), now, settings)
    home.robots.put(files.where(F.col("fetched_at") == now))
    row = (uuid.uuid4().hex[:16], start, now, saved.count(), out_dir)
    home.crawls.put(web.spark.createDataFrame([row], page_store.CRAWLS))
    if web is not responses:
        web.drop()
    return met


def _robots_files(web: Web, frontier: DataFrame, robots_cache: DataFrame | None, now: int, settings: Settings) -> DataFrame:
    """``site, body, fetched_at`` of the frontier's sites: young entries of the cache, else the files in the web."""
    sites = frontier.select(robots.site_of(F.col("url")).alias("site")).distinct()
    asked = C._cut(sites.withColumn("url", F.concat("site", F.lit("/robots.txt"))))
    # No file, or one that could not be fetched, allows all; it is remembered as empty.
    files = web.lookup(asked, asked.count()).select("site", F.when(F.col("status") == 200, F.coalesce("html", F.lit(""))).otherwise("").alias("body"))
    if robots_cache is None:
        return files.withColumn("fetched_at", F.lit(now).cast("long"))
    return store.robots_files(robots_cache.join(sites, "site", "left_semi"), files, ttl_seconds=settings.robots_ttl_seconds, now=now)


def _crawl(spark, web, visited, start, max_pages, max_depth, include, exclude, subdomains, robots_cache, now, settings) -> DataFrame:
    first = spark.range(1).select(U.normalize_url(F.lit(start)).alias("url"), F.lower(U.netloc(F.lit(start))).alias("host")).first()
    frontier = visited.add_new(spark.createDataFrame([(first.url,)], "url string"), 0)
    met, saved = None, 0
    for depth in range(max_depth + 1):
        n = frontier.count()
        if not n:
            break
        files = C._cut(_robots_files(web, frontier, robots_cache, now, settings))
        got = web.lookup(frontier, n).withColumn("error", F.when(F.col("status").isNull(), "no response").otherwise(F.col("error"))).withColumn("status", F.coalesce("status", F.lit(0)))
        got = robots.allowed(S.normalise_responses(got, settings.max_body_bytes), files, settings.user_agent)
        got = got.withColumn("parsed", dom.parsed(F.when(F.col("allowed") & F.col("error").isNull() & (F.col("status") < 400), F.col("html"))))
        got = got.withColumn("markdown", F.col("parsed.markdown")).withColumn("shell", G.needs_render(F.col("html"), F.col("markdown")))
        got = C._cut(C.outcome(got).withColumn("title", F.coalesce("parsed.title", F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url"))))).select("url", "depth", "final_url", "status", "content_type", "via", "outcome", "reason", "title", "markdown", "html"))
        met = got if met is None else met.unionByName(got)
        saved += got.where("outcome = 'saved'").count()
        if depth == max_depth or saved >= max_pages:
            break
        found = links.extract_links(got.where("outcome = 'saved'").withColumn("base", F.coalesce("final_url", "url")), base="base", keys=("url",))
        step = found.select(F.col("link").alias("url")).where(U.frontier_ok(F.col("url"), F.lit(first.host), include, exclude, subdomains))
        frontier = visited.add_new(step, depth + 1)
    way = F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url")))
    met = met.withColumn("path", way)
    kept = C.index(met.where("outcome = 'saved'"), max_pages=max_pages)
    rest = met.where("outcome <> 'saved'").withColumns({"number": F.lit(None).cast("int"), "file": F.lit(None).cast("string"), "tokens": F.lit(None).cast("long"), "line": F.lit(None).cast("string")})
    return kept.unionByName(rest)


def search(docs: DataFrame, query: str, *, max_results: int = 8, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = None, url_col: str | None = None, index: Q.Index | None = None) -> DataFrame:
    """``rank, id, line``: the best documents for a query's words by BM25.

    An ``index`` of the corpus that was written before spares reading texts but those of the hits.
    """
    index = index or Q.Index.write(docs, id_col=id_col, text_col=text_col)
    top = index.search(query, max_results)
    none = F.lit(None).cast("string")
    both = docs.join(F.broadcast(top), docs[id_col] == top["id"])  # max_results rows
    line = Q.result_line(F.col("rank"), F.col(title_col) if title_col else none, F.col(url_col) if url_col else none, none, F.col(text_col))
    return both.select("rank", "id", line.alias("line"))


def tokens(text: Column) -> Column:
    return T.estimate_tokens(text)
