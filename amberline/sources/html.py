"""Pages of HTML to titles and content blocks.

A tree is needed here, so this is an Arrow function over batches: the parser of the standard
library feeds a small tree in which an end tag closes the nearest open element of its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.operators.batches import slices

# Elements and classes that are not content.
CHROME_TAGS = {"nav", "header", "footer", "form", "script", "style", "noscript"}
CHROME_CLASS = re.compile(r"(google-translate|search-\d|social-media|footer-|quicklinks|skip-to-main)")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LABEL_WORDS = 12
#: Bytes of HTML that are parsed before their rows go on.
SLICE = 4 << 20
BLOCKS = "title string, blocks array<struct<kind:string,text:string>>"


class Node:
    __slots__ = ("name", "attrs", "parts", "parent", "span")

    def __init__(self, name: str, attrs: dict[str, str | None], parent: Node | None):
        self.name, self.attrs, self.parent, self.parts, self.span = name, attrs, parent, [], (0, 0)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [p for p in reversed(node.parts) if isinstance(p, Node)]

    def strings(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            else:
                stack += reversed(node.parts)


def spanned(region: Node) -> list[str]:
    """The strings of a region that are not blank, in order; each node gets the part of them that it covers, by one walk."""
    found: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(region, False)]
    while stack:
        node, left = stack.pop()
        if isinstance(node, str):
            if node := node.strip():
                found.append(node)
        elif left:
            node.span = (node.span[0], len(found))
        else:
            node.span = (len(found), 0)
            stack.append((node, True))
            stack += [(p, False) for p in reversed(node.parts)]
    return found


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, dict(attrs), self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def main_region(root: Node) -> Node:
    nodes = list(root.walk())
    tests = (
        lambda n: n.name == "main" and n.attrs.get("id") == "main-content",
        lambda n: n.name == "main",
        lambda n: n.name == "div" and "internal-content" in (n.attrs.get("class") or "").split(),
        lambda n: n.name == "article",
        lambda n: n.name == "body",
    )
    return next((n for test in tests for n in nodes if test(n)), root)


def blocks(html: str | None, url: str | None) -> tuple[str, list[dict[str, str]]]:
    """Title and content blocks. A heading is a heading element, or a short bold run that is all of its
    parent's text; the second time that a heading occurs it counts as text. Null HTML is empty."""
    root = parse(html or "")
    head = next((n for n in root.walk() if n.name == "title"), None)
    title = "".join(s.strip() for s in head.strings()) if head is not None else url or ""
    region = main_region(root)

    def chrome(n: Node) -> bool:
        return n.name in CHROME_TAGS or any(CHROME_CLASS.search(c) for c in (n.attrs.get("class") or "").split())

    for node in list(region.walk()):
        node.parts = [p for p in node.parts if isinstance(p, str) or not chrome(p)]
    strings = spanned(region)
    words = [0, *accumulate(len(x.split()) for x in strings)]

    def label(n: Node) -> bool:
        first, last = n.span
        if first == last:
            return False
        return n.name in HEADINGS or n.name in ("strong", "b") and words[last] - words[first] <= LABEL_WORDS and n.parent is not None and n.parent.span == n.span

    out: list[dict[str, str]] = []
    seen: set[str] = set()
    stack: list[Node | str] = [region]
    while stack:
        node = stack.pop()
        heading = isinstance(node, Node)
        if heading and not label(node):
            stack += reversed(node.parts)
            continue
        for line in (" ".join(strings[slice(*node.span)]) if heading else node).split("\n"):
            if line := line.strip():
                first = heading and line.lower() not in seen
                if first:
                    seen.add(line.lower())
                out.append({"kind": "heading" if first else "text", "text": line})
    return title, out


def plain_title(html: Column) -> Column:
    """The text of the first title element without tags in it, empty if there is none. Only &lt;, &gt; and &amp; stand for
    characters here, in this order; any other reference and one that is cut off stay as they are, unlike in ``blocks``."""
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        title = F.replace(title, F.lit(entity), F.lit(char))
    return F.regexp_replace(title, r"^\p{Zs}+|\p{Zs}+\z", "")


def extracted(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The columns of ``pages`` but the HTML, with ``title`` and ``blocks``."""
    kept = [c for c in pages.columns if c != html]
    schema = pages.select(*kept).schema.add("title", "string")
    schema = schema.add("blocks", pages.sparkSession.createDataFrame([], BLOCKS).schema["blocks"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
        for batch in slices(batches, html, SLICE):
            made = [blocks(h, u) for h, u in zip(batch.column(html).to_pylist(), batch.column(url).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], kind)], names=[*kept, "title", "blocks"])

    return pages.withColumn(html, pages[html].cast("string")).mapInArrow(run, schema)
