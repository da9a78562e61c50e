"""One parse of a page for everything that needs its tree.

The parse is the only step that leaves the JVM; it runs Arrow-batched and returns
JSON that Spark reads with a fixed schema. Text comes out as markdown: headings,
paragraphs, list items, table rows and preformatted blocks of the main content.
"""

from __future__ import annotations

import json
import re
import sys
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import mark_bare

FIELDS = {
    "markdown": "string", "title": "string", "description": "string", "links": "array<string>", "oracle": "string", "json_ld": "array<string>", "opengraph": "map<string,string>", "microdata": "string",
    "tables": "array<struct<caption:string,headers:array<string>,rows:array<array<string>>,truncated:boolean>>",
}
PARSED = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "template", "noscript", "head", "iframe", "svg", "button", "select"}
CHROME = {"nav", "aside", "footer", "form"}
BLOCK = {"address", "article", "blockquote", "body", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul", "aside", "caption"}
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words below which a block without its own heading counts by its neighbours.
SHORT = 12
#: Elements below this depth become siblings, as in browsers, and what they hold stays.
MAX_DEPTH = 512


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self):
        """All nodes below and the text between, in page order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if isinstance(n, Node):
                todo.extend(reversed(n.kids))

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if isinstance(n, Node) and n.tag in tags and n is not self]

    def text(self) -> str:
        return "".join(n for n in self.walk() if isinstance(n, str))


class _Builder(HTMLParser):
    def __init__(self, kept: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.kept = kept  # stands for an & that is no reference
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        for t in IMPLIED.get(tag, ()):
            if self.open[-1].tag == t:
                self.open.pop()
        if tag in BLOCK and self.open[-1].tag == "p":
            self.open.pop()
        node = self.node(tag, attrs)
        self.open[-1].kids.append(node)
        if tag not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(self.node(tag, attrs))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data.replace(self.kept, "&") if self.kept else data)

    def node(self, tag, attrs) -> Node:
        return Node(tag, {k: (v or "").replace(self.kept, "&") if self.kept else v or "" for k, v in attrs})


def decode(body: bytes | str | None) -> str:
    """A body as text: byte-order mark, declared charset, else UTF-8 with replacements."""
    if body is None or isinstance(body, str):
        return body or ""
    body = bytes(body)
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if body.startswith(mark):
            return body.decode(name, "replace")
    m = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", body[:4096], re.I)
    try:
        return body.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def tree(source: str, bare: bool = True) -> Node:
    """Without ``bare``, references that lack their semicolon stay as they are, but for ``&amp``."""
    kept = "" if bare else next(chr(c) for c in range(0xF0000, 0x110000) if chr(c) not in source)
    b = _Builder(kept)
    b.feed(source if bare else mark_bare(source, kept))
    b.close()
    return b.root


def squash(text: str) -> str:
    return " ".join(text.split())


class _Blocks:
    """Blocks of text in page order: kind, text, words, words in links, inside an article."""

    def __init__(self, include_links: bool):
        self.include_links, self.out, self.buf, self.linked = include_links, [], [], 0

    def flush(self, kind: str, inside: bool) -> None:
        text = squash("".join(self.buf))
        if text:
            self.out.append({"kind": kind, "text": text, "words": len(text.split()), "linked": self.linked, "inside": inside})
        self.buf, self.linked = [], 0

    def read(self, node: Node, kind: str, inside: bool) -> None:
        for n in node.kids:
            if isinstance(n, str):
                self.buf.append(n)
                continue
            if n.tag in SKIPPED or n.tag in CHROME:
                if n.tag in CHROME:
                    self.flush(kind, inside)
                continue
            if n.tag == "table":
                self.flush(kind, inside)
                self.table(n, inside)
            elif n.tag == "pre":
                self.flush(kind, inside)
                body = n.text().strip("\n")
                if body.strip():
                    self.out.append({"kind": "pre", "text": body, "words": len(body.split()), "linked": 0, "inside": inside})
            elif n.tag == "a":
                text = squash(n.text())
                self.linked += len(text.split())
                self.buf.append(f"[{text}]({n.attrs.get('href', '')})" if self.include_links and text else n.text())
            elif n.tag == "br":
                self.buf.append(" ")
            elif n.tag in BLOCK:
                self.flush(kind, inside)
                own = n.tag if n.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote") else "p"
                self.read(n, own, inside or n.tag in ("article", "main"))
                self.flush(own, inside or n.tag in ("article", "main"))
            else:
                self.read(n, kind, inside)

    def table(self, node: Node, inside: bool) -> None:
        rows = [[squash(c.text()) for c in tr.kids if isinstance(c, Node) and c.tag in ("td", "th")] for tr in node.find("tr")]
        rows = [r for r in rows if any(r)]
        if rows:
            body = "\n".join("| " + " | ".join(r) + " |" for r in rows)
            words = sum(len(c.split()) for r in rows for c in r)
            self.out.append({"kind": "table", "text": body, "words": words, "linked": 0, "inside": inside})


def _is_content(blocks: list[dict], i: int) -> bool:
    b = blocks[i]
    if b["kind"] in ("table", "pre"):
        return True
    density = b["linked"] / b["words"]
    near = [blocks[j] for j in (i - 1, i + 1) if 0 <= j < len(blocks)]
    if b["kind"][0] == "h" and b["kind"] != "hr":
        return i + 1 < len(blocks) and density < 0.5
    if density > 0.5:
        return False
    return b["words"] >= SHORT or any(x["words"] >= SHORT and x["linked"] < 0.5 * x["words"] for x in near) or len(blocks) <= 3


def main_content(root: Node, include_links: bool = False) -> str | None:
    """The main content as markdown; None where there is none."""
    reader = _Blocks(include_links)
    reader.read(root, "p", False)
    reader.flush("p", False)
    blocks = [b for b in reader.out if b["inside"]]
    if not blocks:
        blocks = [b for i, b in enumerate(reader.out) if _is_content(reader.out, i)]
    lines = []
    for b in blocks:
        kind, text = b["kind"], b["text"]
        if kind in ("h1", "h2", "h3", "h4", "h5", "h6"):
            lines.append("#" * int(kind[1]) + " " + text)
        elif kind == "li":
            lines.append("- " + text)
        elif kind == "pre":
            lines.append("```\n" + text + "\n```")
        elif kind == "blockquote":
            lines.append("> " + text)
        else:
            lines.append(text)
    out = "\n\n".join(lines)
    return out if out.strip() else None


def _metadata(root: Node) -> tuple[str | None, str | None]:
    metas, found = {}, root.find("meta", "h1", "title")
    for m in found:
        key = m.tag == "meta" and (m.attrs.get("property") or m.attrs.get("name"))
        if key and m.attrs.get("content"):
            metas[key.lower()] = m.attrs["content"].strip()
    heads = (squash(n.text()) for tag in ("h1", "title") for n in found if n.tag == tag)
    title = metas.get("og:title") or next((t for t in heads if t), None)
    return title, metas.get("description") or metas.get("og:description")


def tables(root: Node, max_rows: int = 100) -> list[dict]:
    """Captions, header texts and cell texts of all tables, nested ones on their own too."""
    out = []
    for t in root.find("table"):
        captions = t.find("caption")
        headers = [x.strip() for h in t.find("th") for x in h.walk() if isinstance(x, str) and x.strip()]
        rows, truncated = [], False
        for tr in t.find("tr"):
            cells = [squash(c.text()) for c in tr.kids if isinstance(c, Node) and c.tag == "td"]
            if not cells:
                continue
            if len(rows) >= max_rows:
                truncated = True
                break
            rows.append(cells)
        if rows or headers:
            out.append({"caption": (captions[0].text().strip() or None) if captions else None, "headers": headers, "rows": rows, "truncated": truncated})
    return out


def _items(node: Node) -> list[dict]:
    """Microdata items below a node that are no property of another."""
    out = []
    for n in node.kids:
        if isinstance(n, Node):
            if "itemscope" in n.attrs and "itemprop" not in n.attrs:
                out.append(_item(n))
            else:
                out += _items(n)
    return out


def _item(node: Node) -> dict:
    props: dict[str, list] = {}

    def collect(n: Node) -> None:
        for k in n.kids:
            if not isinstance(k, Node):
                continue
            if "itemprop" in k.attrs:
                value = _item(k) if "itemscope" in k.attrs else k.attrs.get("content") or k.attrs.get("href") or k.attrs.get("src") or squash(k.text())
                for name in k.attrs["itemprop"].split():
                    props.setdefault(name, []).append(value)
                if "itemscope" in k.attrs:
                    continue
            collect(k)

    collect(node)
    out = {"type": node.attrs["itemtype"]} if node.attrs.get("itemtype") else {}
    return out | {"properties": {k: v[0] if len(v) == 1 else v for k, v in props.items()}}


def _compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def oracle_text(root: Node) -> str:
    """Text nodes as they stand, without scripts, styles, templates and noscripts."""
    parts, todo = [], [root]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            parts.append(n)
        elif n.tag not in ("script", "style", "template", "noscript"):
            todo.extend(reversed(n.kids))
    return squash("".join(parts))


def _json_ld(root: Node) -> list[str]:
    ld = []
    for s in root.find("script"):
        if s.attrs.get("type", "").strip().lower() == "application/ld+json":
            try:
                data = json.loads(s.text())
                ld += [_compact(x) for x in (data if isinstance(data, list) else [data])]
            except (ValueError, RecursionError):  # no JSON, or nested beyond reason
                continue
    return ld


def _opengraph(root: Node) -> dict[str, str]:
    return {m.attrs["property"]: m.attrs.get("content", "") for m in root.find("meta") if m.attrs.get("property", "").startswith("og:")}


def _microdata(root: Node) -> str | None:
    micro = _items(root)
    return _compact(micro) if micro else None


def parse(body: bytes | str | None, max_rows: int = 100, include_links: bool = False, fields: tuple[str, ...] = tuple(FIELDS), bare: bool = True) -> dict:
    """What ``fields`` name of a page, of one tree."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
    root = tree(decode(body), bare)
    title, description = _metadata(root) if "title" in fields or "description" in fields else (None, None)
    read = {
        "markdown": lambda: main_content(root, include_links),
        "title": lambda: title,
        "description": lambda: description,
        "links": lambda: [a.attrs["href"].strip() for a in root.find("a") if "href" in a.attrs],
        "oracle": lambda: oracle_text(root),
        "json_ld": lambda: _json_ld(root),
        "opengraph": lambda: _opengraph(root),
        "microdata": lambda: _microdata(root),
        "tables": lambda: tables(root, max_rows),
    }
    return {name: read[name]() for name in fields}


def parsed(html: Column, max_rows: int = 100, include_links: bool = False, fields: tuple[str, ...] = tuple(FIELDS), bare: bool = True) -> Column:
    """The parse of a page (text or bytes) as a struct of ``fields``; null for a null page."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: json.dumps(parse(x, max_rows, include_links, fields, bare), ensure_ascii=False), na_action="ignore")

    return F.from_json(run(html), ", ".join(f"{name} {FIELDS[name]}" for name in fields))


def variants(page: Column) -> Column:
    """The structured data of a parse (``parsed``) with JSON as VARIANT values, which are read by path and type without parsing again."""
    return F.struct(
        F.transform(page["json_ld"], F.try_parse_json).alias("json_ld"),
        page["opengraph"].alias("opengraph"),
        F.try_parse_json(page["microdata"]).alias("microdata"),
        page["tables"].alias("tables"),
    )


def hrefs(body: bytes | str | None) -> list[str]:
    """Values of all ``a href`` attributes in page order."""
    return [a.attrs["href"].strip() for a in tree(decode(body)).find("a") if "href" in a.attrs]


def html_tables(body: bytes | str | None, max_rows: int = 100) -> list[dict]:
    return tables(tree(decode(body)), max_rows)


def sitemap(body: bytes | str | None) -> dict:
    """Locations of a sitemap and whether it is an index; nothing for malformed or entity-defining XML."""
    raw = body.encode() if isinstance(body, str) else bytes(body or b"")
    none = {"locs": [], "is_index": False}
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw):
        return none
    try:
        root = ET.fromstring(raw)
    except ET.ParseError:
        return none
    local = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    return {"locs": [e.text.strip() for e in root.iter() if local(e) == "loc" and e.text and e.text.strip()], "is_index": local(root) == "sitemapindex"}


def sitemap_locs(body: Column) -> Column:
    @F.pandas_udf("string")
    def run(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda x: json.dumps(sitemap(x)))

    return F.from_json(run(body), "locs array<string>, is_index boolean")


def pretty_json(text: Column) -> Column:
    """JSON with sorted keys, indented by two; other text as it is."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            try:
                return json.dumps(json.loads(x), indent=2, sort_keys=True)
            except (ValueError, RecursionError):  # no JSON, or nested beyond reason
                return x

        return texts.map(one, na_action="ignore")

    return run(text)
