"""Links of pages, and the map of a site: sitemap entries first, then page links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

#: An anchor's tag, and the attributes in it. Possessive runs: no depth of the matcher's stack goes with the length of a tag.
_ANCHOR = r"""(?is)<a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_ATTRIBUTE = r"""(?is)[^\s"'>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++)"""


def hrefs(html: Column) -> Column:
    """Values of all ``a href`` attributes outside comments, in page order, their character references still encoded."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->|(?i:<script\b.*?</script>)", "")
    attributes = lambda tag: F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 0), lambda a: a.rlike(r"(?i)^href\s*="))
    raw = F.transform(F.regexp_extract_all(bare, F.lit(_ANCHOR), 0), lambda tag: F.try_element_at(attributes(tag), F.lit(1)))
    value = lambda a: F.regexp_replace(F.regexp_replace(a, r"(?i)^href\s*+=\s*+", ""), r"""^["']|["']$""", "")
    return F.transform(F.filter(raw, lambda a: a.isNotNull()), value)


def extract_links(pages: DataFrame, html: str = "html", base: str = "url", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keys, pos, link``: absolute canonical http(s) links, the first of each kept, in page order."""
    rows = pages.select(*keys, F.col(base).alias("_base"), F.posexplode(hrefs(F.col(html))).alias("pos", "_raw"))
    rows = rows.withColumn("_href", T.decode_entities(F.col("_raw")))
    rows = rows.withColumn("_abs", U.once(U.resolve(F.col("_base"), F.col("_href")))).where(F.col("_abs").rlike("^https?://"))
    rows = rows.withColumn("link", U.once(U.normalize_url(F.col("_abs"))))
    return rows.groupBy(*keys, "link").agg(F.min("pos").alias("pos"))


def map_urls(candidates: DataFrame, root_url: str, *, search: str | None = None, max_urls: int = 200, include_subdomains: bool = False) -> DataFrame:
    """``url, source, display`` of (source, pos, url) rows of one site, in order of rank.

    Sources are 'sitemap' (first) and 'links'; a URL counts for the first that has it.
    """
    root = F.lower(U.netloc(F.lit(root_url)))
    rows = candidates.withColumn("url", U.once(U.normalize_url(F.col("url")))).withColumn("_order", F.when(F.col("source") == "sitemap", 0).otherwise(1))
    rows = rows.where(U.host_allowed(F.col("url"), root, include_subdomains) & U.is_crawlable(F.col("url")))
    first = rows.groupBy("url").agg(F.min(F.struct("_order", "pos", "source")).alias("f"))
    out = first.select("url", "f.source", F.col("f._order").alias("_order"), F.col("f.pos").alias("_pos"))
    if search:
        out = out.where(F.contains(F.lower("url"), F.lit(search.lower())))
    return out.orderBy("_order", "_pos", "url").limit(max_urls).select("url", "source", U.display_path(F.col("url"), root).alias("display"))


def map_summary(candidates: DataFrame, root_url: str, *, search: str | None = None, max_urls: int = 200, include_subdomains: bool = False) -> DataFrame:
    """One row ``line``: how many URLs each source gave first, and how many are shown of them."""
    root = F.lower(U.netloc(F.lit(root_url)))
    rows = candidates.withColumn("url", U.once(U.normalize_url(F.col("url"))))
    rows = rows.where(U.host_allowed(F.col("url"), root, include_subdomains) & U.is_crawlable(F.col("url")))
    first = rows.groupBy("url").agg(F.min(F.when(F.col("source") == "sitemap", 0).otherwise(1)).alias("order"))
    match = F.contains(F.lower("url"), F.lit(search.lower())) if search else F.lit(True)
    n = first.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("order") == 0).alias("sitemap"), F.count_if(F.col("order") == 1).alias("links"), F.count_if(match).alias("matching"))
    shown = F.least(F.col("matching"), F.lit(max_urls)).cast("string")
    tail = F.concat(F.lit("; showing "), shown, F.lit(f' matching "{search}"')) if search else F.when(F.col("matching") > max_urls, F.concat(F.lit("; showing "), shown)).otherwise("")
    site = F.concat(U.scheme(F.lit(root_url)), F.lit("://"), U.netloc(F.lit(root_url)))
    return n.select(F.concat(F.lit("site: "), site, F.lit(" — "), F.col("all").cast("string"), F.lit(" urls (sitemap "), F.col("sitemap").cast("string"), F.lit(", links "), F.col("links").cast("string"), F.lit(")"), tail).alias("line"))


def site_sources(candidates: DataFrame, site: str = "site") -> DataFrame:
    """For many sites at once: (site, source, n) after each URL is given to its first source."""
    rows = candidates.withColumn("url", U.once(U.normalize_url(F.col("url")))).withColumn("_order", F.when(F.col("source") == "sitemap", 0).otherwise(1))
    rows = rows.where(U.host_allowed(F.col("url"), F.col(site)) & U.is_crawlable(F.col("url")))
    first = rows.groupBy(site, "url").agg(F.min(F.struct("_order", "pos", "source")).alias("f"))
    return first.groupBy(site, F.col("f.source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


def child_sitemaps(children: DataFrame, max_urls: int, max_children: int = 20, key: tuple[str, ...] = ()) -> DataFrame:
    """Of an index's (pos, locs) children the first ``max_children``, as far as 2 * max_urls locations go.

    With ``key`` the children are those of many indexes, each with a running sum of its own.
    """
    own = Window.partitionBy(*key).orderBy("pos")
    if key:
        few = children.withColumn("_nth", F.row_number().over(own)).where(F.col("_nth") <= max_children).drop("_nth")
    else:
        few = children.orderBy("pos").limit(max_children)  # at most max_children rows from here
    before = F.coalesce(F.sum(F.size("locs")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return few.withColumn("_before", before).where(F.col("_before") < 2 * max_urls).drop("_before")


def map_sites(candidates: DataFrame, *, max_urls: int = 200, include_subdomains: bool = False) -> DataFrame:
    """``site, rank, url, source`` of (site, source, pos, url) rows: each site's map as ``map_urls`` has it, for many at once."""
    rows = candidates.withColumn("url", U.once(U.normalize_url(F.col("url")))).withColumn("_order", F.when(F.col("source") == "sitemap", 0).otherwise(1))
    root = F.lower(U.netloc(F.col("site")))
    rows = rows.where(U.host_allowed(F.col("url"), root, include_subdomains) & U.is_crawlable(F.col("url")))
    first = rows.groupBy("site", "url").agg(F.min(F.struct("_order", "pos", "source")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("f._order", "f.pos", "url"))
    return first.withColumn("rank", rank).where(F.col("rank") <= max_urls).select("site", "rank", "url", "f.source")
