"""URL canonicalisation, hashing and crawl predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
TRACKING_NAMES = ("fbclid", "gclid", "ref")
TRACKING_PREFIX = "utm_"
# File extensions that are not content pages.
ASSET_EXTENSIONS = (
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "css", "js", "mjs", "map", "woff", "woff2", "ttf", "otf", "eot", "zip", "gz", "tar", "tgz", "bz2", "7z", "rar", "dmg", "exe", "msi",
    "mp3", "mp4", "mov", "avi", "mkv", "webm", "wav", "flac", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
)
MAX_QUERY_PARAMS = 3

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def once(value: Column) -> Column:
    """A value that later steps read and do not compute anew (a generator of one row, for ``select`` and ``withColumn``).

    Predicates name a URL many times, and the optimizer would put the whole expression into each place.
    """
    return F.explode(F.array(value))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def _decode(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column) -> Column:
    """Decoded (k, v) pairs of the query, blank values kept, empty pieces dropped."""
    pieces = F.filter(F.split(query(url), "&"), lambda x: x != "")
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit(""))
    return F.transform(pieces, lambda x: F.struct(_decode(F.substring_index(x, "=", 1)).alias("k"), _decode(value(x)).alias("v")))


def _is_tracking(name: Column) -> Column:
    return name.isin(*TRACKING_NAMES) | F.startswith(name, F.lit(TRACKING_PREFIX))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slash, no fragment, tracking dropped, query sorted."""
    kept = F.array_sort(F.filter(query_pairs(url), lambda p: ~_is_tracking(p["k"])))
    q = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    host, way, sch = F.lower(netloc(url)), F.regexp_replace(path(url), "/+$", ""), scheme(url)
    way = F.when((host != "") & (way != "") & ~F.startswith(way, F.lit("/")), F.concat(F.lit("/"), way)).otherwise(way)
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        way,
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )


def url_hash(url: Column) -> Column:
    """32 hexadecimal digits of the SHA-256 of the canonical URL."""
    return F.substring(F.sha2(normalize_url(url), 256), 1, 32)


def is_crawlable(url: Column) -> Column:
    """Whether a URL is likely a content page: http(s), few parameters, no repeating path, no asset."""
    seg = F.filter(F.split(path(url), "/"), lambda s: s != "")
    n = F.size(seg)
    at = F.when(n >= 4, F.sequence(F.lit(1), n - 3)).otherwise(F.array().cast("array<int>"))
    loops = F.exists(at, lambda i: (F.element_at(seg, i) == F.element_at(seg, i + 2)) & (F.element_at(seg, i + 1) == F.element_at(seg, i + 3)))
    last = F.coalesce(F.try_element_at(seg, F.lit(-1)), F.lit(""))
    asset = F.contains(last, F.lit(".")) & F.lower(F.substring_index(last, ".", -1)).isin(*ASSET_EXTENSIONS)
    return scheme(url).isin("http", "https") & (F.size(query_pairs(url)) <= MAX_QUERY_PARAMS) & ~loops & ~asset


def host_allowed(url: Column, root_host: Column, include_subdomains: bool = False) -> Column:
    """Whether the URL's host is the root's, or (on request) under the root's base domain."""
    host = F.lower(netloc(url))
    same = host == root_host
    if not include_subdomains:
        return same
    bare = F.regexp_replace(root_host, r"^www\.", "")
    dots = F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit("")))
    base = F.when(dots >= 2, F.regexp_replace(bare, r"^[^.]*\.", "")).otherwise(bare)
    return same | (host == base) | F.endswith(host, F.concat(F.lit("."), base))


def display_path(url: Column, root_host: Column) -> Column:
    """Path and query for URLs of the host, the whole URL for others."""
    way = F.when(path(url) == "", "/").otherwise(path(url))
    q = query(url)
    return F.when(F.lower(netloc(url)) == root_host, F.concat(way, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))).otherwise(url)


def _without_dots(way: Column) -> Column:
    parts = F.split(way, "/", -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        none,
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(kept, "/"), F.when(tail, "/").otherwise(""))


def resolve(base: Column, href: Column) -> Column:
    """A reference against a base URL (RFC 3986)."""
    ref = F.trim(F.regexp_replace(href, r"^[\s]+|[\s]+$", ""))
    tail = F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    way = path(ref)
    merged = F.when(F.startswith(way, F.lit("/")), way).otherwise(F.concat(F.when(path(base) == "", "/").otherwise(F.regexp_replace(path(base), "[^/]*$", "")), way))
    base_query = F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise("")
    return (
        F.when((scheme(ref) != "") & (scheme(ref) == scheme(base)), F.concat(scheme(ref), F.regexp_replace(ref, "^[^:]+", "")))
        .when(scheme(ref) != "", ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref == "", F.regexp_replace(base, "#.*$", ""))
        .when(F.startswith(ref, F.lit("#")), F.concat(root, path(base), base_query, ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(root, path(base), ref))
        .otherwise(F.concat(root, _without_dots(merged), tail))
    )


def glob_match(value: Column, pattern: str) -> Column:
    """Shell-style match of the whole value; ``*`` crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i:j].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = j + 1
        else:
            out += "\\" + ch if not (ch.isalnum() or ch == "_" or ord(ch) > 127) else ch
    return value.rlike(f"(?s)^(?:{out})\\z")


def frontier_ok(url: Column, root_host: Column, include: list[str] | None = None, exclude: list[str] | None = None, subdomains: bool = False) -> Column:
    """Whether a crawl from the root host follows this URL; an excluding pattern wins."""
    way = F.when(path(url) == "", "/").otherwise(path(url))
    ok = host_allowed(url, root_host, subdomains) & is_crawlable(url)
    for p in exclude or []:
        ok = ok & ~glob_match(way, p)
    if include:
        any_of = F.lit(False)
        for p in include:
            any_of = any_of | glob_match(way, p)
        ok = ok & any_of
    return ok
