"""Table functions for SQL: ``SELECT ... FROM pages, LATERAL extract_links(html, url)``.

They take a page and give rows, as Python table functions with Arrow batches; ``register`` names
them in a session. In the DataFrame API the same rows come from ``operators.links`` and ``operators.dom``.
"""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import dom
from ..session import prepare
from .urls import TRACKING_NAMES, TRACKING_PREFIX


def canonical(url: str) -> str:
    """The canonical form of ``functions.urls.normalize_url``, for one URL."""
    parts = urlsplit(url)
    kept = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k not in TRACKING_NAMES and not k.startswith(TRACKING_PREFIX))
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path.rstrip("/"), urlencode(kept), ""))


@udtf(returnType="pos int, link string", useArrow=True)
class ExtractLinks:
    """Absolute canonical http(s) links of a page, each where it stands first."""

    def eval(self, html: str, base: str):
        seen = set()
        for pos, href in enumerate(dom.hrefs(html)):
            try:
                link = urljoin(base or "", href)
                if not link.startswith(("http://", "https://")):
                    continue
                link = canonical(link)
            except ValueError:  # a malformed link is left out
                continue
            if link not in seen:
                seen.add(link)
                yield pos, link


@udtf(returnType="number int, caption string, headers array<string>, rows array<array<string>>, truncated boolean", useArrow=True)
class HtmlTables:
    """Tables of a page, with at most ``max_rows`` rows each."""

    def eval(self, html: str, max_rows: int = 100):
        for i, t in enumerate(dom.html_tables(html, max_rows)):
            yield i, t["caption"], t["headers"], t["rows"], t["truncated"]


@udtf(returnType="pos int, loc string, is_index boolean", useArrow=True)
class SitemapLocations:
    """Locations of a sitemap, and whether it is an index of sitemaps."""

    def eval(self, body: str):
        found = dom.sitemap(body)
        for i, loc in enumerate(found["locs"]):
            yield i, loc, found["is_index"]


def register(spark: SparkSession) -> None:
    """Name the functions ``extract_links``, ``html_tables`` and ``sitemap_locations`` for SQL."""
    prepare(spark)
    for name, function in (("extract_links", ExtractLinks), ("html_tables", HtmlTables), ("sitemap_locations", SitemapLocations)):
        spark.udtf.register(name, function)
