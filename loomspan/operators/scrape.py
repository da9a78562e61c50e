"""What becomes of a request: cache, fetch, refusals, routes by type, extraction, judgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions import text as T
from ..functions import urls as U
from . import dom

MAX_BODY_BYTES = 5 * 1024 * 1024


def route(content_type: Column) -> Column:
    """pdf, json, plain, unsupported or html."""
    ct = content_type
    return (
        F.when(ct == "application/pdf", "pdf")
        .when((ct == "application/json") | F.endswith(ct, F.lit("+json")), "json")
        .when(ct == "text/plain", "plain")
        .when((ct != "") & ~F.startswith(ct, F.lit("text/")) & (ct != "application/xhtml+xml"), "unsupported")
        .otherwise("html")
    )


def normalise_responses(df: DataFrame, max_bytes: int = MAX_BODY_BYTES) -> DataFrame:
    """Responses with a bare lower-case content type; bodies over the cap go, with an error and their status."""
    big = F.octet_length("html") > max_bytes
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    out = df.withColumn("content_type", kind)
    out = out.withColumn("error", F.when(big, F.lit(f"response too large (>{max_bytes} bytes)")).otherwise(F.col("error")))
    return out.withColumn("html", F.when(~big, F.col("html")))


#: What ``outcomes`` reads of a parse.
JUDGED = ("markdown", "title")


def with_extraction(df: DataFrame, include_links: bool = False, max_rows: int = 100, fields: tuple[str, ...] = tuple(dom.FIELDS)) -> DataFrame:
    """Adds ``parsed`` (the page's parse, or ``fields`` of it) for responses that a parse is wanted of."""
    want = (route(F.col("content_type")) == "html") & F.col("error").isNull() & (F.col("status") < 400)
    return df.withColumn("parsed", dom.parsed(F.when(want, F.col("html")), max_rows, include_links, fields))


def prefer_rendered(fetched: DataFrame, rendered: DataFrame, key: str = "url") -> DataFrame:
    """Each response, or its rendering where that extracts strictly more.

    Both sides have ``markdown``; ``rendered`` is a table of renderings (a browser
    is a source like any other), and a page without one stays as fetched.
    """
    r = rendered.select(F.col(key), F.struct(*[c for c in rendered.columns if c != key]).alias("_r"))
    both = fetched.join(r, key, "left")
    more = F.col("_r").isNotNull() & (F.coalesce(F.length("_r.markdown"), F.lit(-1)) > F.coalesce(F.length("markdown"), F.lit(-1)))
    return both.select(key, *[F.when(more, F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) for c in fetched.columns if c != key])


def outcomes(df: DataFrame, raw: bool = False) -> DataFrame:
    """Responses (with ``parsed``) with ``outcome``, judgement and what a reader gets."""
    kind = route(F.col("content_type"))
    html = F.col("html")
    markdown, title = F.col("parsed.markdown"), F.col("parsed.title")
    text = T.visible_text(html)
    rows = df.withColumn("page_text", text).withColumn("quality", G.quality(html, F.col("page_text"), markdown, title))
    refused = F.startswith("content_type", F.lit("text/")) & F.coalesce(G.looks_blocked(html), F.lit(False))
    shell = markdown.isNull() | G.needs_render(html, markdown)
    code = (
        F.when(F.col("error").isNotNull(), "fetch_error")
        .when(F.col("status") >= 400, "http_error")
        .when(refused, "blocked_raw")
        .when(kind == "pdf", F.when(F.col("pdf_text").isNull(), "pdf_failed").otherwise("pdf") if "pdf_text" in df.columns else F.lit("pdf_failed"))
        .when(kind == "json", "json")
        .when(kind == "plain", "plain")
        .when(kind == "unsupported", "unsupported")
    )
    if raw:
        code = code.when(F.col("page_text") == "", "raw_empty").otherwise("raw")
    else:
        code = code.when(shell, "shell").when(F.col("quality.consent_wall"), "consent_wall").when(F.col("quality.block_wall"), "blocked_extracted").otherwise("content")
    # A filter by outcome stays above the parse, which would else be made twice.
    rows = rows.withColumn("outcome", U.once(code))
    body = F.when(F.col("outcome").isin("raw", "plain"), F.when(F.col("outcome") == "raw", F.col("page_text")).otherwise(html)).when(F.col("outcome") == "content", markdown)
    if "pdf_text" in df.columns:
        body = body.when(F.col("outcome") == "pdf", F.col("pdf_text"))
    return rows.withColumn("body", body).withColumn("title", F.when(F.col("outcome") == "content", title))


def cacheable(rows: DataFrame) -> DataFrame:
    """Outcomes that a store keeps: extracted pages and PDF texts, never walls, shells or raw text."""
    return rows.where(F.col("outcome").isin("content", "pdf")).withColumn("url_hash", U.url_hash(F.col("url")))


def report(url: Column, title: Column, fetched: Column, body: Column, warnings: Column, max_length: int = 8000) -> Column:
    """The text that a reader gets: a header, a line, and the body up to ``max_length``."""
    cut = T.truncate(body, max_length)
    total = T.estimate_tokens(body).cast("string")
    copy = F.concat(F.substring(U.url_hash(url), 1, 12), F.lit(".md"))
    tokens = F.when(cut["truncated"], F.concat(F.lit("tokens: ~"), T.estimate_tokens(cut["shown"]).cast("string"), F.lit(" of ~"), total, F.lit(" (truncated; full copy: "), copy, F.lit(")"))).otherwise(F.concat(F.lit("tokens: ~"), total))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("url: "), url),
        F.when(title != "", F.concat(F.lit("title: "), title)),
        F.concat(F.lit("fetched: "), fetched),
        tokens,
        F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("warning: "), w)), "\n") if warnings is not None else F.lit(None).cast("string"),
        F.lit("---"),
        cut["shown"],
    )


def structured(parsed: Column, url: Column, types: tuple[str, ...] = ("json-ld", "opengraph", "microdata", "tables")) -> Column:
    """JSON of the non-empty kinds of structured data, or a note that there is none."""
    json_of = {
        "json_ld": ("json-ld", F.when(F.size(parsed["json_ld"]) > 0, F.concat(F.lit("["), F.array_join(parsed["json_ld"], ","), F.lit("]")))),
        "opengraph": ("opengraph", F.when(F.size(parsed["opengraph"]) > 0, F.to_json(parsed["opengraph"]))),
        "microdata": ("microdata", parsed["microdata"]),
        "tables": ("tables", F.when(F.size(parsed["tables"]) > 0, F.to_json(parsed["tables"]))),
    }
    # Each kind is JSON already, so the members are put one after the other.
    kinds = [F.concat(F.lit(f'"{name}":'), value) for name, (kind, value) in json_of.items() if kind in types]
    found = F.filter(F.array(*kinds), lambda x: x.isNotNull()) if kinds else F.array().cast("array<string>")
    members = F.when(F.size(found) == 0, F.array(F.lit('"note":"no structured data found"'))).otherwise(found)
    # ``{"url":...}`` without its brace
    head = F.to_json(F.struct(F.coalesce(url, F.lit("")).alias("url")))
    return F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(","), F.array_join(members, ","), F.lit("}"))
