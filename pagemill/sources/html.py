"""Saved web pages and JATS articles as Markdown."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

NODES, ROWS, COLUMNS, CELLS, IMAGES = 100_000, 2000, 128, 10_000, 256
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_DROPPED = {"script", "style", "noscript", "template", "nav", "form", "button", "input", "select", "textarea", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "head", "title"}
_BLOCKS = {"address", "article", "aside", "body", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "footer", "header", "main", "section", "summary"}
#: Tags that end an open tag of the same group.
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_ENDS_P = _BLOCKS | {"table", "ul", "ol", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr"}


class TooLarge(ValueError):
    """A page beyond one of the bounds; an error, never cut."""


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list["Node | str"] = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def find(self, tag: str) -> "Node | None":
        return next((n for n in self.walk() if n.tag == tag), None)

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Tree(HTMLParser):
    """Tree of a page; unclosed paragraphs, items and cells end where the next begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.nodes = 0

    def _count(self) -> None:
        self.nodes += 1
        if self.nodes > NODES:
            raise TooLarge("too many nodes")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._count()
        ends = _ENDS.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in ends:
                del self.open[i:]
                break
            if self.open[i].tag in ("table", "ul", "ol", "dl", "div", "article", "section", "blockquote"):
                break
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self._count()
        self.open[-1].children.append(data)


def _spaces(s: str) -> str:
    return re.sub(r"\s+", " ", s.replace("\xa0", " "))


def _escape(s: str) -> str:
    return re.sub(r"([\\`*_\[\]<>])", r"\\\1", _spaces(s))


def local_image(base: str, src: str) -> str | None:
    """Path of a local image relative to the page, or None."""
    raw = re.split(r"[?#]", src.strip(), maxsplit=1)[0]
    if not raw or raw[0] in "/\\" or re.match(r"(?i)[a-z][a-z0-9+.-]*:", raw) or re.search(r"%(?![0-9A-Fa-f]{2})", raw):
        return None
    try:
        path = unquote_to_bytes(raw).decode().replace("\\", "/")
    except UnicodeDecodeError:
        return None
    if not re.search(r"(?i)\.(?:avif|bmp|gif|jpe?g|png|webp)$", path):
        return None
    parts = base.replace("\\", "/").split("/")[:-1]
    for s in path.split("/"):
        if s == "..":
            if not parts:
                return None
            parts.pop()
        elif s not in ("", "."):
            parts.append(s)
    return "/".join(parts)


def _link(href: str) -> str | None:
    h = href.strip()
    if re.match(r"(?i)(?:https?:|mailto:)", h):
        return re.sub(r"[()\s]", lambda m: quote(m[0], safe=""), h)
    return h if h.startswith("#") else None


class _Writer:
    def __init__(self, base: str, available: set[str] | None):
        self.base, self.available = base, available
        self.images: list[str] = []
        self.blocked: list[str] = []
        self.count = 0

    def block(self, s: str) -> str:
        return f"\n\n{s.strip()}\n\n" if s.strip() else ""

    def inner(self, n: Node) -> str:
        s = "".join(map(self.write, n.children))
        return re.sub(r"[ \t]{2,}", " ", re.sub(r" +\n", "\n", s)).strip()

    def table(self, n: Node) -> str:
        rows = [[c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in n.walk() if r.tag == "tr"]
        if len(rows) > ROWS or any(len(r) > COLUMNS for r in rows) or sum(map(len, rows)) > CELLS:
            raise TooLarge("table too large")
        if not rows or not rows[0]:
            return ""
        cells = [[" ".join(self.inner(c).replace("|", "\\|").split()) for c in r] for r in rows]
        width = max(map(len, cells))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in cells]
        return self.block("\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]))

    def image(self, n: Node) -> str:
        self.count += 1
        if self.count > IMAGES:
            raise TooLarge("too many images")
        src, alt = n.attrs.get("src", ""), _escape(n.attrs.get("alt", "")).strip()
        path = local_image(self.base, src)
        if path is None or (self.available is not None and path not in self.available):
            if src:
                self.blocked.append(src)
            return alt
        if path not in self.images:
            self.images.append(path)
        return f"\n\n![{alt}]({path})\n\n"

    def write(self, n: "Node | str") -> str:
        if isinstance(n, str):
            return _escape(n)
        t = n.tag
        if t in _DROPPED:
            return ""
        if t in ("br", "hr", "img", "table", "pre"):
            fence = "`" * 3
            code = n.text().strip() if t == "pre" else ""
            return {"br": lambda: "\n", "hr": lambda: "\n\n---\n\n", "img": lambda: self.image(n), "table": lambda: self.table(n), "pre": lambda: self.block(f"{fence}\n{code}\n{fence}") if code else ""}[t]()
        if t in ("ul", "ol"):
            items = [self.inner(c) for c in n.children if isinstance(c, Node) and c.tag == "li"]
            return self.block("\n".join((f"{i}. " if t == "ol" else "- ") + x for i, x in enumerate(items, 1)))
        s = self.inner(n)
        if not s:
            return ""
        if re.fullmatch(r"h[1-6]", t):
            return self.block("#" * int(t[1]) + " " + s)
        marks = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "code": "`"}
        if t in marks:
            return marks[t] + s + marks[t]
        if t == "a":
            href = _link(n.attrs.get("href", ""))
            return f"[{s}]({href})" if href else s
        if t == "blockquote":
            return self.block("\n".join("> " + x for x in s.split("\n")))
        if t == "p" or t in _BLOCKS:
            return self.block(s)
        # keep the blanks at the ends of an inline element
        raw = n.text()
        return (" " if raw[:1].isspace() else "") + s + (" " if raw[-1:].isspace() else "")


def html_to_markdown(source: str, base: str = "index.html", available: set[str] | None = None) -> tuple[str, str | None, list[str], list[str]]:
    """Markdown, title, local images and blocked image sources of a page.

    The root is the first article, else main, else the whole page. Scripts, styles,
    navigation and controls are left out; links are kept if http(s), mailto or within
    the page.
    """
    tree = _Tree()
    tree.feed(source)
    tree.close()
    root = tree.root.find("article") or tree.root.find("main") or tree.root.find("body") or tree.root
    title_node = tree.root.find("title")
    title = _escape(title_node.text()).strip() or None if title_node else None
    w = _Writer(base, available)
    md = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", w.write(root))).strip()
    if title and not re.search(r"(?m)^#\s+", md):
        md = f"# {title}\n\n{md}".strip()
    return md, title, w.images, list(dict.fromkeys(w.blocked))


def _flat(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def jats_to_markdown(xml: str) -> str:
    """Title, abstract, sections to two levels with their paragraphs, and figures of a JATS article; empty if it is no XML."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return ""
    out: list[str] = []
    title = root.find(".//article-title")
    if title is not None:
        out.append("# " + _flat(title))
    abstract = root.find(".//abstract")
    if abstract is not None and _flat(abstract):
        out += ["## Abstract", *(_flat(p) for p in abstract.iter("p"))]

    def section(sec: ET.Element, level: int) -> None:
        head = sec.find("title")
        if head is not None:
            out.append("#" * level + " " + _flat(head))
        for c in sec:
            if c.tag == "p":
                out.append(_flat(c))
            elif c.tag == "fig":
                label, caption = c.find("label"), c.find("caption")
                out.append(" ".join(x for x in ("**" + _flat(label) + "**" if label is not None else "", _flat(caption) if caption is not None else "") if x))
            elif c.tag == "sec" and level < 3:
                section(c, level + 1)

    for sec in root.findall(".//body/sec"):
        section(sec, 2)
    return "\n\n".join(x for x in out if x)


PAGES = "doc_id string, markdown string, title string, images array<string>, blocked array<string>, problem string"


def convert(pages: DataFrame, kind: str = "html") -> DataFrame:
    """Pages (doc_id, source text) as Markdown, see ``PAGES``; a page beyond a bound has a problem and no text, a null one is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s is None:
                    continue
                try:
                    rows.append((i, *(html_to_markdown(s) if kind == "html" else (jats_to_markdown(s), None, [], [])), None))
                except TooLarge as e:
                    rows.append((i, None, None, [], [], str(e)))
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PAGES.split(", ")])

    return pages.selectExpr("cast(doc_id as string) as doc_id", "source").mapInArrow(run, PAGES)
