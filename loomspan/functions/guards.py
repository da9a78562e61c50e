"""Judgements on extractions: walls, shells, gated pages, lost prices, collapsed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Phrases and limits that decide the judgements.
CONSENT_PHRASES = ("we use cookies", "do not sell or share my personal information", "save my preferences", "accept all cookies", "manage preferences", "your privacy choices")
CONSENT_MAX_CHARS = 2000
BLOCK_PHRASES = ("complete the captcha", "solve the captcha", "flagged as potentially automated", "attention required", "verify you are a human", "are you a robot", "enable javascript and cookies to continue", "checking your browser")
BLOCK_MAX_CHARS = 600
RAW_BLOCK_MARKERS = ("complete the captcha", "solve the captcha", "flagged as potentially automated", "attention required!", "verify you are a human", "are you a robot", "enable javascript and cookies to continue")
RAW_BLOCK_MAX_BYTES = 30_000
SHELL_MARKERS = ('id="root"', 'id="app"', 'id="__next"', "__NUXT__", "data-reactroot")
SHELL_TEXT_FLOOR = 250
SCRIPT_SHARE = 0.6
NOSCRIPT = r"(?is)<noscript[^>]*>.{0,400}?(?:enable\s+javascript|javascript\s+is\s+required)"
CHALLENGE_MARKERS = ("just a moment", "cf-chl")
CHALLENGE_BYTES = 4096
GATED_MIN_HTML = 50_000
GATED_MAX_TEXT = 2000
CLUSTER_SIZE, CLUSTER_WINDOW, MIN_RETAINED = 4, 1500, 0.5
PRICING_TITLE = r"(?i)pricing|plans? and pricing|tarif|preise"
TITLED_SIZE = 3
RUN_LENGTH, MIN_RUNS, MAX_RUN_LINE = 3, 2, 80


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(text, F.lit(p))
    return out


def looks_blocked(html: Column) -> Column:
    """A small body with the words of a bot wall."""
    small = F.coalesce(F.octet_length(html), F.lit(0)).between(1, RAW_BLOCK_MAX_BYTES)
    return F.when(small, any_of(F.lower(html), RAW_BLOCK_MARKERS)).otherwise(False)


def is_challenge(html: Column) -> Column:
    return F.coalesce(any_of(F.lower(F.substring(html, 1, CHALLENGE_BYTES)), CHALLENGE_MARKERS), F.lit(False))


def script_share(html: Column) -> Column:
    scripts = F.regexp_extract_all(html, F.lit(r"(?s)(<script\b.*?</script>)"), 1)
    return F.aggregate(scripts, F.lit(0), lambda a, s: a + F.octet_length(s)) / F.octet_length(html)


def needs_render(html: Column, extracted: Column) -> Column:
    """Whether a page looks like an empty shell that a browser would fill."""
    shell = F.when(html.rlike(NOSCRIPT) | any_of(html, SHELL_MARKERS), True).when(html == "", False).otherwise(script_share(html) > SCRIPT_SHARE)
    return F.when(F.coalesce(F.length(extracted), F.lit(0)) >= SHELL_TEXT_FLOOR, False).otherwise(F.coalesce(shell, F.lit(False)))


def is_consent_wall(markdown: Column) -> Column:
    return F.when(F.length(markdown) < CONSENT_MAX_CHARS, any_of(F.lower(markdown), CONSENT_PHRASES)).otherwise(False)


def is_block_wall(markdown: Column) -> Column:
    return F.when(F.length(markdown) < BLOCK_MAX_CHARS, any_of(F.lower(markdown), BLOCK_PHRASES)).otherwise(False)


def has_price_cluster(page_text: Column) -> Column:
    """Whether some window of the text holds CLUSTER_SIZE different figures.

    One pass: of the figures met so far, the latest CLUSTER_SIZE different ones are kept with
    where each stood last, so the oldest of them says whether a window that ends here holds all.
    """
    recent = "array<struct<fig:string,pos:int>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(recent).alias("recent"), F.lit(False).alias("found"))

    def step(a: Column, z: Column) -> Column:
        pos = a["at"] + z["gap"]
        others = F.slice(F.filter(a["recent"], lambda r: r["fig"] != z["fig"]), 1, CLUSTER_SIZE - 1)
        oldest = F.try_element_at(others, F.lit(CLUSTER_SIZE - 1))["pos"]
        found = a["found"] | F.coalesce(pos - oldest <= CLUSTER_WINDOW, F.lit(False))
        return F.struct((pos + F.length(z["fig"])).alias("at"), F.concat(F.array(F.struct(z["fig"].alias("fig"), pos.alias("pos"))), others).alias("recent"), found.alias("found"))

    return F.coalesce(F.aggregate(T.figure_gaps(page_text), begin, step)["found"], F.lit(False))


def run_count(markdown: Column) -> Column:
    """Runs of RUN_LENGTH and more equal short lines."""
    ls = T.lines(markdown)
    begin = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("len"), F.lit(0).alias("runs"))

    def step(a: Column, line: Column) -> Column:
        n = F.when(F.coalesce(a["last"] == line, F.lit(False)), a["len"] + 1).otherwise(1)
        return F.struct(line.alias("last"), n.alias("len"), (a["runs"] + F.when((n == RUN_LENGTH) & (F.length(line) < MAX_RUN_LINE), 1).otherwise(0)).alias("runs"))

    return F.aggregate(ls, begin, step)["runs"]


def has_collapsed_columns(markdown: Column) -> Column:
    return run_count(markdown) >= MIN_RUNS


def quality(html: Column, page_text: Column, markdown: Column, title: Column) -> Column:
    """(consent_wall, block_wall, warnings) of an extraction; a wall ends the judgement.

    A warning is (code, n, total): gated has kilobytes and characters,
    prices_dropped the lost and all figures, columns_collapsed the runs.
    """
    kb, chars = F.floor(F.octet_length(html) / 1024).cast("long"), F.length(page_text).cast("long")
    on_page = F.array_distinct(T.figures(page_text))
    kept = F.size(F.array_intersect(on_page, T.figures(markdown)))
    total = F.size(on_page)
    titled = F.coalesce(title.rlike(PRICING_TITLE), F.lit(False)) & (total >= TITLED_SIZE)
    dropped = (titled | has_price_cluster(page_text)) & (kept / total < MIN_RETAINED)
    warning = lambda code, n, m: F.struct(F.lit(code).alias("code"), n.cast("long").alias("n"), m.cast("long").alias("total"))
    warnings = F.filter(
        F.array(
            F.when((F.octet_length(html) > GATED_MIN_HTML) & (chars < GATED_MAX_TEXT), warning("gated", kb, chars)),
            F.when(dropped, warning("prices_dropped", total - kept, total)),
            F.when(has_collapsed_columns(markdown), warning("columns_collapsed", run_count(markdown), F.lit(None))),
        ),
        lambda w: w.isNotNull(),
    )
    consent = F.coalesce(is_consent_wall(markdown), F.lit(False))
    block = ~consent & F.coalesce(is_block_wall(markdown), F.lit(False))
    none = F.array().cast("array<struct<code:string,n:bigint,total:bigint>>")
    return F.struct(consent.alias("consent_wall"), block.alias("block_wall"), F.when(markdown.isNull() | consent | block, none).otherwise(warnings).alias("warnings"))


def warning_text(w: Column) -> Column:
    """A warning in words."""
    n, total = w["n"].cast("string"), w["total"].cast("string")
    return (
        F.when(w["code"] == "gated", F.concat(F.lit("the markup has "), n, F.lit(" KB but about "), total, F.lit(" characters of visible text; the content is likely gated or was never rendered")))
        .when(w["code"] == "prices_dropped", F.concat(F.lit("the extraction lost "), n, F.lit(" of "), total, F.lit(" distinct prices of the page")))
        .otherwise(F.lit("repeated identical rows: a table with several columns may have collapsed"))
    )
