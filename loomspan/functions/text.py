"""Text expressions: visible text, figures, token estimates, truncation, slugs."""

from __future__ import annotations

import html as html_module
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x1c-\x1f]"
#: Fixed value: a currency sign, digits with commas, and cents.
MONEY = r"[$€£][0-9][0-9,]*(?:\.[0-9]{2})?"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: References that need no table: the rest goes through an Arrow UDF.
_PLAIN = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&#39;": "'"}
_OTHER = r"&(?!(?:copy|middot|quot|lt|gt|nbsp|#39|amp);)[#A-Za-z]"
_AND = re.compile(r"&(?!amp|#[0-9]+;|#[xX][0-9A-Fa-f]+;)([A-Za-z][A-Za-z0-9]*;)?")


def mark_bare(text: str, mark: str) -> str:
    """``mark`` for each & that begins no whole reference: one with its semicolon, or ``&amp`` with or without."""
    return _AND.sub(lambda m: m[0] if m[1] in html5 else mark + m[0][1:], text)


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html_module.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_whole(text: pd.Series) -> pd.Series:
    return text.map(lambda x: html_module.unescape(mark_bare(x, "&amp;")), na_action="ignore")


def decode_entities_native(text: Column) -> Column:
    """The common character references."""
    plain = text
    for name, ch in _PLAIN.items():
        plain = F.replace(plain, F.lit(name), F.lit(ch))
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))


def decode_entities(text: Column, bare: bool = True) -> Column:
    """Character references of HTML; only rows with uncommon ones are sent to Python.

    HTML knows old names without their semicolon too (``&quot``, ``&copy``). Without ``bare`` these stay as
    they are, but for ``&amp``.
    """
    plain = decode_entities_native(text)
    unescape = _unescape if bare else _unescape_whole
    return F.when(text.rlike(_OTHER), unescape(F.when(text.rlike(_OTHER), text))).otherwise(plain)


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"(?U){SPACE}+", " "), "^ | $", "")


def strip_markup(html: Column) -> Column:
    """Scripts, styles and tags out, references still encoded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.regexp_replace(bare, "<[^>]+>", " ")


def visible_text(html: Column, bare: bool = True) -> Column:
    """The text a reader could see: no scripts, styles or tags; references decoded; white space collapsed."""
    return collapse(decode_entities(strip_markup(F.coalesce(html, F.lit(""))), bare))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def truncate(text: Column, max_chars: int) -> Column:
    """(shown, truncated): cut after the last line break within the limit, else at the limit; 0 is no limit."""
    if max_chars <= 0:
        return F.struct(text.alias("shown"), F.lit(False).alias("truncated"))
    head = F.substring(text, 1, max_chars + 1)
    after = F.length(F.substring_index(head, "\n", -1))
    cut = F.length(head) - after  # the break itself included, 0 if there is none
    shown = F.when(F.length(text) <= max_chars, text).when(cut > 1, F.substr(text, F.lit(1), cut)).otherwise(F.substring(text, 1, max_chars))
    return F.struct(shown.alias("shown"), (F.length(text) > max_chars).alias("truncated"))


def slugify(text: Column, max_len: int = 60) -> Column:
    s = F.regexp_replace(F.lower(text), "['’]", "")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    s = F.when(F.length(s) > max_len, F.regexp_replace(F.substring(s, 1, max_len), "-[^-]*$", "")).otherwise(s)
    return F.when(s == "", "untitled").otherwise(s)


def snippet(text: Column, limit: int = 200) -> Column:
    flat = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) > limit, F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"\s+$", ""), F.lit("…"))).otherwise(flat)


def figures(text: Column) -> Column:
    """All money figures in order."""
    return F.regexp_extract_all(text, F.lit(f"({MONEY})"), 1)


def figure_gaps(text: Column) -> Column:
    """(gap, fig) of all money figures: code points since the figure before, and the figure."""
    between = F.transform(F.split(text, MONEY, -1), F.length)
    pairs = F.arrays_zip(between.alias("gap"), figures(text).alias("fig"))
    return F.filter(pairs, lambda z: z["fig"].isNotNull())  # the last gap has no figure after it


def figure_positions(text: Column) -> Column:
    """(pos, fig) of all money figures, in code points."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,fig:string>>").alias("out"))
    step = lambda a, z: F.struct((a["at"] + z["gap"] + F.length(z["fig"])).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + z["gap"]).alias("pos"), z["fig"].alias("fig")))).alias("out"))
    return F.aggregate(figure_gaps(text), start, step)["out"]


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    trimmed = F.transform(F.split(text, LINE_BREAK, -1), lambda x: F.regexp_replace(x, f"(?U)^{SPACE}+|{SPACE}+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def pad(text: Column, width: int) -> Column:
    """Blanks at the right up to a width; longer texts stay whole."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text))))


def utf8(body: Column) -> Column:
    """A body's bytes as text, bad sequences replaced."""
    return F.make_valid_utf8(body.cast("string"))
