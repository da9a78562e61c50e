"""Main text of web pages by differencing with the nearest page of the host.

A page becomes lines: the text of each block element, with character references
decoded and white space as one space. Two pages of one host whose URL paths stand
next to each other share their menus, notices and footers, so each page is
aligned with its nearest page by the longest common subsequence of lines, and the
lines that both have are deleted. All lines take part; a page is aligned where that can
change its text, so not if markup has settled each of its lines.

Differencing alone can't give right results where a neighbour repeats part of
an article, or where a footer or an advert is made anew for each page, so the
markup is a weight where it speaks:

* text inside ``article`` or ``main`` is the article's and stays, though a neighbour has it too;
* ``nav``, ``header``, ``footer``, ``aside``, ``form`` and the like, and elements whose class,
  id or role names them as chrome, go even where no neighbour has their lines;
* elements inside an article whose names tell little (OPEN: a notice, a share box or the
  author's own section) go by the difference, and without a partner as chrome;
* all other lines go by the difference alone, and stay on a page without a partner.

Pages are paired in one sort by (host, path, page id) of ids and paths alone; a
page's partner is the one before it, or the one after it for a host's first. Sort
partitions' borders (one row each) are exchanged through the driver. For the alignment
a page's lines travel as 64-bit hashes; its text meets the decisions once.

Defined cases: null or empty HTML gives the empty text; a null URL has no host and
no partner; repeated rows with one page id give a row each, aligned with the same
partner; other columns, of whatever name, are ignored; an empty table gives no rows. A
page is parsed whole in one task, without recursion and in time linear in its length.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .textbuf import prefix_sums, range_hash, utf8

BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Their contents are no markup.
RAW = frozenset("script style template noscript textarea title iframe svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form head button select dialog menu label input fieldset".split())
ROOTS = frozenset(("article", "main"))
_NAMES = r"(?:^|[\s_-])(?:{})(?:$|[\s_-])"
NAMED = re.compile(
    _NAMES.format(r"nav(?:bar|igation)?|menu|breadcrumbs?|footer|sidebar|side-bar|ads?|advert\w*|sponsor\w*|cookies?|consent|popup|modal|newsletter|subscribe|comments?|disqus|replies|reply|respond|toolbar|pagination|pager|skip-link"),
    re.I,
)
#: Names that an author's own sections have too.
OPEN = re.compile(_NAMES.format(r"banner|promo\w*|notices?|share|social|related|widget"), re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_START = re.compile(r"<!--|<[!?]|<(/?)[a-zA-Z]")
_NAME_END = re.compile(r"[^\s/>]*+")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_QUOTED = re.compile(r"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: A start tag of the first closes an open one of the second.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What the markup says of a line: nothing, that it is the article's, that it is chrome, or that it may be chrome inside an article.
ASKED, KEPT, MARKED, DOUBTED = 0, 1, 2, 3


@dataclass
class Line:
    text: str
    state: int


@dataclass
class _Page:
    lines: list[Line] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)

    def end_block(self, state: int) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                self.lines.append(Line(text, state))


def _state(tag: str, attributes: str, state: int) -> int:
    """The state of an element's contents, from that of the element around it."""
    if state == MARKED:
        return MARKED
    if tag in ROOTS:
        return KEPT
    inside = state in (KEPT, DOUBTED)
    if tag in DROPPED and not (tag == "header" and inside):  # an article's own heading
        return MARKED
    if attributes and tag not in ("body", "html"):
        for m in _ATTR.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if (value.lower() in ROLES) if m[1].lower() == "role" else NAMED.search(value):
                return MARKED
            if m[1].lower() != "role" and OPEN.search(value):
                state = DOUBTED if inside else MARKED
    return state


class _Tags:
    """The tags of a page, in linear time however many never end.

    A tag that finds no end leaves its quoted stretches: another whose attributes begin outside of these goes the same
    way to the same end. A place is outside quotes, or within one of two kinds, so at most three such ways are kept.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.name = (0, 0)  # the last name read
        self.dead: list[tuple[list[int], list[int]]] = []  # begins and ends of quotes

    def _name_end(self, at: int) -> int:
        if not self.name[0] <= at < self.name[1]:  # else the rest of that name
            self.name = (at, _NAME_END.match(self.source, at).end())
        return self.name[1]

    def _lost(self, at: int) -> bool:
        for begins, ends in self.dead:
            i = bisect.bisect_right(begins, at) - 1
            if i < 0 or begins[i] == at or ends[i] <= at:
                return True
        return False

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(begin, end, whether it closes, name, attributes) of the next tag; comments and declarations have no name."""
        while m := _START.search(self.source, at):
            begin = m.start()
            if m[0] == "<!--":
                end = self.source.find("-->", m.end())
                return begin, end + 3 if end >= 0 else len(self.source), False, "", ""
            if begin > self.last:  # only a comment needs no end
                begin = self.source.find("<!--", begin)
                if begin < 0:
                    return None
                at = begin
                continue
            if m[1] is None:
                return begin, self.source.index(">", begin) + 1, False, "", ""
            named = self._name_end(m.end() - 1)
            if not self._lost(named):
                end = _ATTRIBUTES.match(self.source, named).end()
                if end < len(self.source) and self.source[end] == ">":
                    return begin, end + 1, bool(m[1]), self.source[m.end() - 1 : named].lower(), self.source[named:end]
                quotes = [q.span() for q in _QUOTED.finditer(self.source, named)]
                self.dead.append(([q[0] for q in quotes], [q[1] for q in quotes]))
            at = m.end()
        return None


def page_lines(source: str | None) -> list[Line]:
    """The lines of a page, in page order, with what the markup says of each."""
    page, stack = _Page(), []  # of (tag, state around it)
    open_tags: Counter[str] = Counter()
    state = ASKED
    source = source or ""
    tags = _Tags(source)
    at, n = 0, len(source)

    def pop() -> tuple[str, int]:
        open_tags[stack[-1][0]] -= 1
        return stack.pop()

    while at < n:
        found = tags.after(at)
        if found is None:
            cut = re.compile(r"<[a-zA-Z/!?]").search(source, at)  # a tag that never ends
            page.parts.append(source[at : cut.start()] if cut else source[at:])
            break
        begin, end, closes, tag, attributes = found
        if begin > at:
            page.parts.append(source[at:begin])
        at = end
        if not tag:
            continue
        if closes:
            if open_tags[tag]:
                if tag in BLOCKS:
                    page.end_block(state)
                while stack:
                    t, before = pop()
                    if t in BLOCKS:
                        page.end_block(state)
                    state = before
                    if t == tag:
                        break
            elif tag in BLOCKS:
                page.end_block(state)
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = close.end() if close else n
            continue
        if tag in BLOCKS:
            page.end_block(state)
        for t in CLOSES.get(tag, ()):
            if stack and any(x == t for x, _ in stack[-3:]):
                while stack and stack[-1][0] != t and stack[-1][0] not in BLOCKS:
                    state = pop()[1]
                if stack and stack[-1][0] == t:
                    state = pop()[1]
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        stack.append((tag, state))
        open_tags[tag] += 1
        state = _state(tag, attributes, state)
    page.end_block(state)
    return page.lines


def common(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < min(len(a), len(b)) - start and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = set(range(start)) | set(range(len(a) - tail, len(a)))
    both = set(a[start : len(a) - tail]) & set(b[start : len(b) - tail])
    x = [i for i in range(start, len(a) - tail) if a[i] in both]
    y = [j for j in range(start, len(b) - tail) if b[j] in both]
    # Hunt and Szymanski: the places in b of each line, and the best chains' ends.
    places: dict[str, list[int]] = {}
    for k, j in enumerate(y):
        places.setdefault(b[j], []).append(k)
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in x:
        for k in reversed(places[a[i]]):
            r = bisect.bisect_left(ends, k)
            link = (i, links[r - 1] if r else None)
            if r == len(ends):
                ends.append(k)
                links.append(link)
            else:
                ends[r], links[r] = k, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages -> their text where markup settles every line, else their lines and states; and the lines' hashes."""
    for batch in batches:
        pages = [page_lines(h) for h in batch.column(3).to_pylist()]
        data, offsets = utf8(pa.array([x.text for p in pages for x in p], pa.large_string()))
        h = range_hash(prefix_sums(data), offsets[:-1], offsets[1:]) if len(data) else np.zeros(0, np.uint64)
        at = np.cumsum([0, *map(len, pages)])
        hashes = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
        asks = [any(x.state in (ASKED, DOUBTED) for x in p) for p in pages]
        texts = pa.array([None if a else " ".join(x.text for x in p if x.state == KEPT) for p, a in zip(pages, asks)], pa.string())
        lines = pa.array([[x.text for x in p] if a else None for p, a in zip(pages, asks)], pa.list_(pa.string()))
        states = pa.array([[x.state for x in p] for p in pages], pa.list_(pa.int8()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts, lines, states, hashes], names=["row", "page_id", "url", "text", "lines", "states", "hashes"])


def _gone(states: list[int], own: list[int], other: list[int] | None) -> tuple[list[int], list[int]]:
    """Lines that go because the partner has them, and those that go by markup alone."""
    both = common(own, other) if other else set()
    shared = [i for i, s in enumerate(states) if s != KEPT and i in both]
    return shared, [i for i, s in enumerate(states) if i not in both and (s == MARKED or s == DOUBTED and other is None)]


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for lines, states, own, other in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
            gone = set().union(*_gone(states, own, other))
            out.append(" ".join(t for i, t in enumerate(lines) if i not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = [_gone(*x) for x in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([len(g[i]) for g in gone], pa.int64()) for i in (0, 1))], names=["page_id", "n_shared", "n_marked"])


def partners(keys: DataFrame) -> DataFrame:
    """``row, partner``: for each of (row, host, path) the nearest page of its host."""
    spark = keys.sparkSession
    sort = ["host", "path", "row"]
    placed = keys.where("host is not null").repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "order")
    edge = F.struct(*sort)
    edges = sorted(placed.groupBy("part").agg(F.min(edge).alias("low"), F.max(edge).alias("high")).collect(), key=lambda r: tuple(r.low))
    before = [(b.part, a.high.host, a.high.row) for a, b in zip(edges, edges[1:])]
    after = [(a.part, b.low.host, b.low.row) for a, b in zip(edges, edges[1:])]
    before = F.broadcast(spark.createDataFrame(before, "part int, before_host string, before_row long"))  # one row a partition
    after = F.broadcast(spark.createDataFrame(after, "part int, after_host string, after_row long"))
    inside = Window.partitionBy("part").orderBy(*sort)
    near = placed.withColumns({"lag": F.lag(F.struct("host", "row")).over(inside), "lead": F.lead(F.struct("host", "row")).over(inside)})
    near = near.join(before, "part", "left").join(after, "part", "left")
    lag_host, lag_row = F.coalesce("lag.host", "before_host"), F.coalesce("lag.row", "before_row")
    lead_host, lead_row = F.coalesce("lead.host", "after_host"), F.coalesce("lead.row", "after_row")
    partner = F.when(lag_host == F.col("host"), lag_row).when(lead_host == F.col("host"), lead_row)
    return near.select("row", partner.alias("partner"))


def _read(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> tuple[DataFrame, DataFrame]:
    """(the pages as read, each row's partner)."""
    # Rows get a number of their own, so that repeated and null ids are pages like others.
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("row", F.xxhash64("page_id", "url", F.xxhash64("html")))
    rest = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "/+$", "")
    keys = rows.select("row", F.when(host != "", host).alias("host"), path.alias("path")).dropDuplicates(["row"])
    near = materialise(partners(keys), "partners")
    kind = dict(pages.dtypes)
    schema = f"row long, page_id {kind[id_col]}, url {kind[url_col]}, text string, lines array<string>, states array<byte>, hashes array<long>"
    return materialise(rows.select("row", "page_id", "url", "html").mapInArrow(_reader, schema), "pages"), near


def _with_partner(rows: DataFrame, read: DataFrame, near: DataFrame) -> DataFrame:
    other = read.select(F.col("row").alias("partner"), F.col("hashes").alias("other")).dropDuplicates(["partner"])
    return rows.join(near, "row", "left").join(other, "partner", "left")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``."""
    read, near = _read(pages, id_col, url_col, html_col)
    # Only texts that the difference can change are shuffled.
    both = _with_partner(read.where("text is null"), read, near).select("page_id", "url", "lines", "states", "hashes", "other")
    kind = dict(pages.dtypes)
    settled = both.mapInArrow(_differ, f"page_id {kind[id_col]}, url {kind[url_col]}, text string")
    out = read.where("text is not null").select("page_id", "url", "text").unionByName(settled)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def deleted_lines(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, n_shared, n_marked``: how many lines go because the partner has them, and by markup alone."""
    read, near = _read(pages, id_col, url_col, html_col)
    both = _with_partner(read, read, near).select("page_id", "states", "hashes", "other")
    return both.mapInArrow(_counter, f"page_id {dict(pages.dtypes)[id_col]}, n_shared long, n_marked long")
