"""HTML to typed blocks, links, tables and fingerprints: small parsers inside Arrow UDFs."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

HEADINGS = {"h1", "h2", "h3", "h4"}
SKIPPED = {"script", "style", "noscript", "template"}
BREAKS = {"div", "section", "article", "nav", "header", "footer", "ul", "ol", "tr", "table", "tbody", "thead", "blockquote"}
VOID = {"br", "img", "hr", "input", "meta", "link", "col", "wbr", "area", "base", "source"}
STRUCK = {"del", "s", "strike"}


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        yield self
        for child in self.children:
            if isinstance(child, Node):
                yield from child.walk()

    def path(self) -> str:
        parts, at = [], self
        while at.parent is not None:
            same = [c for c in at.parent.children if isinstance(c, Node) and c.tag == at.tag]
            parts.append(f"{at.tag}[{same.index(at) + 1}]")
            at = at.parent
        return "/" + "/".join(reversed(parts))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def inline_text(node: Node, strike: bool = False) -> str:
    """Text with br as a line feed and block tags as a space; struck text between ~~ if asked for."""
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(re.sub(r"[ \t\r\n\xa0]+", " ", child))
        elif child.tag == "br":
            parts.append("\n")
        elif child.tag not in SKIPPED:
            inner = inline_text(child, strike)
            if strike and child.tag in STRUCK and inner.strip():
                inner = f"~~{inner.strip()}~~"
            parts.append(f" {inner} " if child.tag in BREAKS or child.tag in HEADINGS or child.tag in ("p", "li", "td", "th") else inner)
    text = "".join(parts)
    return "\n".join(re.sub(" +", " ", x).strip() for x in text.split("\n")).strip() if node.tag in HEADINGS | {"p", "li", "td", "th"} else text


def table_grid(table: Node) -> list[list[str]]:
    """Rows of a table with spans filled by the source cell's text; empty columns at the end are dropped."""
    grid: dict[tuple[int, int], str] = {}
    rows = [n for n in table.walk() if n.tag == "tr"]
    for r, row in enumerate(rows):
        c = 0
        for cell in (x for x in row.children if isinstance(x, Node) and x.tag in ("td", "th")):
            while (r, c) in grid:
                c += 1
            span = lambda name: min(max(int(cell.attrs.get(name) or 1) if (cell.attrs.get(name) or "1").isdigit() else 1, 1), 200)  # noqa: B023,E731
            text = inline_text(cell)
            for i in range(min(span("rowspan"), len(rows) - r)):
                for j in range(span("colspan")):
                    grid.setdefault((r + i, c + j), text)
            c += span("colspan")
    width = max((c for _, c in grid), default=-1) + 1
    out = [[grid.get((r, c), "") for c in range(width)] for r in range(len(rows))]
    while out and out[0] and not any(row[-1] for row in out):
        out = [row[:-1] for row in out]
    return out


def _is_layout(table: Node) -> bool:
    rows = [n for n in table.walk() if n.tag == "tr"]
    return all(sum(isinstance(c, Node) and c.tag in ("td", "th") for c in r.children) <= 1 for r in rows)


def blocks(html: str | None) -> list[dict]:
    """Headings, paragraphs, list items and data tables in order, with their path; a table of single cells is transparent."""
    found: list[dict] = []

    def visit(node: Node) -> None:
        for child in node.children:
            if not isinstance(child, Node) or child.tag in SKIPPED:
                continue
            kind = "heading" if child.tag in HEADINGS else {"p": "paragraph", "li": "list_item"}.get(child.tag)
            if child.tag == "table" and not _is_layout(child):
                rows = table_grid(child)
                found.append({"kind": "table", "text": "\n".join("\t".join(r) for r in rows), "xpath": child.path()})
            elif kind:
                text = inline_text(child, strike=True)
                if text:
                    found.append({"kind": kind, "text": text, "xpath": child.path()})
            else:
                visit(child)

    visit(parse(html))
    return found


def render(html: str | None) -> str:
    """Plain text: cells parted by tabs, rows and blocks by line feeds, blank lines dropped, NFC."""
    parts: list[str] = []

    def visit(node: Node) -> None:
        for child in node.children:
            if isinstance(child, str):
                parts.append(re.sub(r"[ \t\r\n\xa0]+", " ", child))
            elif child.tag not in SKIPPED:
                visit(child)
                if child.tag in ("td", "th"):
                    parts.append("\t")
                elif child.tag in BREAKS or child.tag in HEADINGS or child.tag in ("p", "li", "br"):
                    parts.append("\n")

    visit(parse(html))
    lines = (re.sub(" *\t *", "\t", re.sub(" +", " ", x)).strip() for x in "".join(parts).split("\n"))
    return unicodedata.normalize("NFC", "\n".join(x for x in lines if x))


def links(html: str | None) -> list[dict]:
    return [{"href": n.attrs["href"], "text": " ".join(inline_text(n).split())} for n in parse(html).walk() if n.tag == "a" and n.attrs.get("href")]


def semantic_fingerprint(html: str | None) -> str:
    """Hash of tags, text and the attributes that carry meaning; style and counters don't change it."""
    def shape(node: Node) -> list:
        kept = {k: v for k, v in node.attrs.items() if k in ("href", "src", "alt", "rowspan", "colspan")}
        inner = [shape(c) if isinstance(c, Node) else " ".join(c.split()) for c in node.children if not (isinstance(c, Node) and c.tag in SKIPPED)]
        return [node.tag, kept, [x for x in inner if x]]

    return hashlib.sha256(json.dumps(shape(parse(html)), sort_keys=True, ensure_ascii=False).encode()).hexdigest()


#: Words that signal a revision in a text.
SIGNALS = {
    "extension": "연장|extend", "correction": "정정|correct", "cancellation": "취소|철회|cancel", "change": "변경|change", "repost": "재공고|재게시|repost",
    "additional": "추가 ?모집|additional", "deadline": "마감|deadline", "notice": "공지|notice",
}


def revision_signals(text: str | None, around: int = 200) -> list[dict]:
    """Markers with kind, offset and context: the paragraph, or `around` characters on either side of a long one."""
    out = []
    text = text or ""
    for kind, pattern in SIGNALS.items():
        for m in re.finditer(pattern, text, re.IGNORECASE):
            start, stop = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            stop = len(text) if stop < 0 else stop
            if stop - start > 500:
                start, stop = max(start, m.start() - around), min(stop, m.end() + around)
            out.append({"kind": kind, "offset": m.start(), "context": text[start:stop]})
    return sorted(out, key=lambda x: (x["offset"], x["kind"]))


def transcription_blocks(text: str | None) -> list[dict]:
    """Markdown-like transcription: headings, paragraphs, and tables of | rows or of HTML, in order."""
    out: list[dict] = []
    for part in re.split(r"\n\s*\n|(?=<table)|(?<=</table>)", text or ""):
        part = part.strip()
        if not part:
            continue
        rows = [x.strip() for x in part.split("\n")]
        if part.startswith("<table"):
            grid = next((table_grid(n) for n in parse(part).walk() if n.tag == "table"), [])
            out.append({"kind": "table", "text": "\n".join("\t".join(r) for r in grid), "xpath": ""})
        elif len(rows) > 1 and all(r.startswith("|") for r in rows):
            cells = [[c.strip() for c in r.strip("|").split("|")] for r in rows if not re.fullmatch(r"[|\s:-]+", r)]
            out.append({"kind": "table", "text": "\n".join("\t".join(r) for r in cells), "xpath": ""})
        elif m := re.match(r"#{1,6}\s+(.*)", part):
            out.append({"kind": "heading", "text": m[1].split("\n")[0], "xpath": ""})
            if rest := "\n".join(part.split("\n")[1:]).strip():
                out.append({"kind": "paragraph", "text": rest, "xpath": ""})
        else:
            out.append({"kind": "paragraph", "text": part, "xpath": ""})
    return out


def _own_links(item: Node) -> list[Node]:
    """Links of an item, without those of the items of a list in it."""
    found: list[Node] = []
    for child in item.children:
        if isinstance(child, Node) and child.tag not in SKIPPED | {"li"}:
            found += ([child] if child.tag == "a" and "href" in child.attrs else []) + _own_links(child)
    return found


def absolute_url(href: str, page_url: str | None) -> str | None:
    """The HTTP(S) address that a link on a page leads to, or None: a place on the page, another scheme, no host."""
    href = href.strip()
    if not href or href.startswith("#"):
        return None
    try:
        found = urljoin(page_url or "", href)
        parts = urlsplit(found)
    except ValueError:
        return None
    return found if parts.scheme in ("http", "https") and parts.netloc else None


def list_items(html: str | None, page_url: str | None) -> dict:
    """Items of a page's lists in order, each with its address and title; strict: the page fails whole, and tells the row, without a
    list or with an item that hasn't just one link of its own, to an HTTP(S) address and with a title.
    """
    failed = lambda error: {"ok": False, "error": error, "items": []}
    items = []
    for order, row in enumerate((n for n in parse(html).walk() if n.tag == "li"), 1):
        found = _own_links(row)
        if len(found) != 1:
            return failed(f"list row {order} link: expected 1 element, found {len(found)}")
        href = absolute_url(found[0].attrs["href"], page_url)
        if href is None:
            return failed(f"list row {order}: href missing or not HTTP(S)")
        title = unicodedata.normalize("NFC", " ".join(inline_text(found[0]).split()))
        if not title:
            return failed(f"list row {order}: empty title")
        items.append({"list_order": order, "href": href, "title": title})
    return {"ok": True, "error": None, "items": items} if items else failed("no list")


_S = StringType()
_BLOCKS = ArrayType(StructType([StructField("kind", _S), StructField("text", _S), StructField("xpath", _S)]))


@F.pandas_udf(_BLOCKS)
def html_blocks(html: pd.Series) -> pd.Series:
    return html.map(blocks)


@F.pandas_udf(_BLOCKS)
def text_blocks(text: pd.Series) -> pd.Series:
    return text.map(transcription_blocks)


@F.pandas_udf(_S)
def html_text(html: pd.Series) -> pd.Series:
    return html.map(render)


@F.pandas_udf(_S)
def html_fingerprint(html: pd.Series) -> pd.Series:
    return html.map(semantic_fingerprint)


@F.pandas_udf(ArrayType(StructType([StructField("href", _S), StructField("text", _S)])))
def html_links(html: pd.Series) -> pd.Series:
    return html.map(links)


@F.pandas_udf(ArrayType(StructType([StructField("kind", _S), StructField("offset", IntegerType()), StructField("context", _S)])))
def signals(text: pd.Series) -> pd.Series:
    return text.map(revision_signals)


_ITEMS = ArrayType(StructType([StructField("list_order", IntegerType()), StructField("href", _S), StructField("title", _S)]))


@F.pandas_udf(StructType([StructField("ok", BooleanType()), StructField("error", _S), StructField("items", _ITEMS)]))
def html_list(html: pd.Series, page_url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([list_items(*x) for x in zip(html, page_url)], columns=["ok", "error", "items"])
