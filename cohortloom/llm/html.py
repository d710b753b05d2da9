"""Layout-aware text of HTML pages.

A page is cut into tags and text, a tree builder supplies the end tags that HTML leaves out, and a renderer walks the tree:
hidden elements are left out, blocks stand on lines of their own, paragraphs and headings are set apart by a blank line,
list items are marked and indented, preformatted text keeps its blanks and the cells of a table are aligned in columns.
All visible text is emitted; nothing is judged as boilerplate.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head script style template noscript iframe object video audio canvas noembed noframes datalist param source track".split())
#: Parts of formulas and drawings that are not shown.
HIDDEN_IN_FOREIGN = frozenset("annotation annotation-xml title desc defs metadata".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption select xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp table figure".split())
TABLE_PARTS = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
#: Start tags that end an open element: tag -> (elements ended, elements beyond which nothing is ended).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Blocks whose start ends an open paragraph, unless a table cell or a button lies between.
ENDS_PARAGRAPH = BLOCK - {"html", "body", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend", "summary", "select"} | {"li"}
PARAGRAPH_SCOPE = frozenset("td th caption button object table".split())

# A quoted value may hold ">"; an unclosed quote ends with the text, and then the "<" is taken as text.
TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
BLANKS = re.compile(r"[ \t\n\r\f]+")
HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
#: The content of elements nested deeper is laid into the one at this depth, so that a hostile page can't exhaust the walk.
#: They stay on the stack of open elements, so that their end tags close no other.
MOST_DEPTH = 200


class Element:
    __slots__ = ("tag", "hidden", "start", "children")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1):
        self.tag, self.hidden, self.start = tag, hidden, start
        self.children: list[Element | str] = []


def _element(tag: str, attributes: str) -> Element:
    hidden, start = tag in HIDDEN, 1
    if attributes.strip(" /\t\r\n"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), next(filter(None, values), "")
            if name == "hidden" and value.lower() != "until-found":
                hidden = True
            elif name == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif name == "style" and HIDING_STYLE.search(unescape(value)):
                hidden = True
            elif name == "type" and tag == "input":
                hidden = True
            elif name == "start" and tag == "ol" and re.fullmatch(r"-?\d{1,9}", value.strip()):
                start = int(value)
    return Element(tag, hidden, start)


def build_tree(page: str) -> Element:
    """The tree of a page. End tags without a start are ignored; open elements end with their parent or the page."""
    root = Element("#root")
    open_: list[Element] = [root]
    #: Where the elements of each tag stand on the stack.
    where: dict[str, list[int]] = {}

    def begin(element: Element) -> None:
        where.setdefault(element.tag, []).append(len(open_))
        open_.append(element)

    def end_down_to(index: int) -> None:
        while len(open_) > index:
            element = open_.pop()
            where[element.tag].pop()
            if len(open_) >= MOST_DEPTH and element.tag in BLOCK and not element.hidden:
                element.children.append(Element("div"))

    def nearest(tags: Iterable[str]) -> int:
        """Index of the innermost open element of ``tags``, or 0."""
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def find(tags, scope) -> int:
        """Index of the outermost open element of ``tags`` above the nearest of ``scope``, or 0."""
        low = nearest(scope)
        return min((some[k] for t in tags if (some := where.get(t)) and (k := bisect_right(some, low)) < len(some)), default=0)

    at, n = 0, len(page)
    while at < n:
        match = TAG.search(page, at)
        if match is None:
            open_[-1].children.append(page[at:])
            break
        if match.start() > at:
            open_[-1].children.append(page[at : match.start()])
        at = match.end()
        tag = match[2]
        foreign = nearest(("svg", "math")) > nearest(("foreignobject",))
        if tag is None:
            if foreign and page.startswith("<![CDATA[", match.start()):
                end = page.find("]]>", match.start())
                open_[-1].children.append(escape(page[match.start() + 9 : end if end >= 0 else n]))
                at = end + 3 if end >= 0 else n
            continue
        tag = tag.lower()
        if match[1]:
            scope = {"table"} if tag not in TABLE_PARTS else set() if tag == "table" else {"table"} - {tag}
            index = nearest((tag,))
            if index > nearest(scope - {tag}):
                end_down_to(index)
            elif tag == "p" or tag == "br":
                open_[-1].children.append(Element(tag))
            continue
        if tag in ENDS:
            index = find(*ENDS[tag])
            if index:
                end_down_to(index)
        if tag in ENDS_PARAGRAPH:
            index = find({"p"}, PARAGRAPH_SCOPE)
            if index:
                end_down_to(index)
        element = _element(tag, match[3])
        open_[-1].children.append(element)
        if foreign and tag in HIDDEN_IN_FOREIGN:
            element.hidden = True
        if tag in VOID or (match[3].endswith("/") and (foreign or tag in ("svg", "math"))):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            end = close.start() if close else n
            if tag in ("textarea", "title") and not element.hidden:
                element.children.append(page[at:end])
            elif tag == "xmp" and not element.hidden:
                # Nothing in it is a character reference.
                element.children.append(escape(page[at:end]))
            at = close.end() if close else n
        else:
            if len(open_) >= MOST_DEPTH and not element.hidden:
                element = Element(tag)
                element.children = open_[-1].children
            begin(element)
    return root


class Writer:
    """Lines of text with pending breaks and blanks, so that neighbouring margins fall together."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = self.gap = False

    def text(self, text: str, keep: bool = False) -> None:
        if keep:
            first, *rest = text.expandtabs(8).split("\n")
            self.put(first, True)
            for line in rest:
                self.lines.append("".join(self.line).rstrip())
                self.line, self.blank = [], False
                self.put(line, True)
            return
        words = BLANKS.split(text)
        for i, word in enumerate(words):
            if i:
                self.blank = True
            if word:
                self.put(word)

    def put(self, text: str, keep: bool = False) -> None:
        if not text:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.blank and self.line and not keep:
            self.line.append(" ")
        self.blank = False
        self.line.append(text)

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.blank = [], False

    def hard_break(self) -> None:
        if self.line or self.lines:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.blank = [], False

    def apart(self) -> None:
        self.end_line()
        self.gap = bool(self.lines)

    def block(self, lines: list[str]) -> None:
        """Lines that were laid out elsewhere."""
        for line in lines:
            self.put(line, True)
            self.lines.append("".join(self.line).rstrip())
            self.line = []

    def result(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def render(element: Element, out: Writer, kept: bool = False) -> None:
    """Write an element's children. Lists, quotes and tables lay out their content apart and indent or align it."""
    number = element.start
    for child in element.children:
        if isinstance(child, str):
            if element.tag not in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol", "select") or child.strip():
                out.text(unescape(child) if "&" in child else child, kept)
            continue
        tag = child.tag
        if child.hidden:
            continue
        if tag == "br":
            out.hard_break()
        elif tag == "hr":
            out.apart()
        elif tag == "wbr" or tag in VOID:
            continue
        elif tag == "table":
            out.apart()
            out.block(table_lines(child))
            out.apart()
        elif tag in ("ul", "ol", "menu", "dir", "blockquote", "dd") or tag == "li":
            inner = Writer()
            render(child, inner, kept)
            lines = inner.result()
            if tag in SPACED and element.tag != "li":
                out.apart()
            else:
                out.end_line()
            mark = ""
            if tag == "li":
                mark = f"{number}. " if element.tag == "ol" else "- "
                number += 1
            indent = " " * len(mark) if tag == "li" else "  " if tag in ("blockquote", "dd") else ""
            out.block([(mark if i == 0 and mark else indent) + line if line else line for i, line in enumerate(lines)])
            if tag in SPACED and element.tag != "li":
                out.apart()
        elif tag in BLOCK or tag == "text":
            # A text of a drawing has a place of its own.
            out.apart() if tag in SPACED else out.end_line()
            render(child, out, kept or tag in ("pre", "xmp"))
            out.apart() if tag in SPACED else out.end_line()
        else:
            if tag == "q":
                out.text('"')
            render(child, out, kept or tag == "textarea")
            if tag == "q":
                out.put('"', True)


def _rows(element: Element) -> Iterator[Element]:
    for child in element.children:
        if isinstance(child, Element) and not child.hidden:
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


def table_lines(table: Element) -> list[str]:
    """Caption and stray content first, then the rows; a cell's lines stand under each other, columns share a width."""
    stray = Element("div")
    stray.children = [c for c in table.children if isinstance(c, str) or c.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup")]
    for group in (c for c in table.children if isinstance(c, Element) and c.tag in ("thead", "tbody", "tfoot") and not c.hidden):
        stray.children += [c for c in group.children if isinstance(c, str) or c.tag != "tr"]
    grid: list[list[list[str]]] = []
    for row in _rows(table):
        cells = []
        for child in row.children:
            if isinstance(child, Element) and child.tag in ("td", "th"):
                if not child.hidden:
                    inner = Writer()
                    render(child, inner)
                    cells.append(inner.result())
            else:
                stray.children.append(child)
        if any(cells):
            grid.append(cells)
    out = Writer()
    render(stray, out)
    lines = out.result()
    columns = max(map(len, grid), default=0)
    widths = [max((len(line) for cells in grid if c < len(cells) for line in cells[c]), default=0) for c in range(columns)]
    for cells in grid:
        for i in range(max(map(len, cells))):
            parts = [(cell[i] if i < len(cell) else "").ljust(widths[c]) for c, cell in enumerate(cells)]
            lines.append("  ".join(p for c, p in enumerate(parts) if widths[c]).rstrip())
    return lines


def page_text(page: str) -> str:
    out = Writer()
    render(build_tree(page.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")), out)
    return "\n".join(out.result())


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The rows of ``pages`` with ``out`` in place of ``html`` (and of a column already called so).

    Null stays null; an empty page, or one without visible text, gives an empty text; equal pages give equal texts; an
    empty table stays empty. Pages are read whole, one at a time, in a pass without shuffle.
    """
    keep = [c for c in pages.columns if c not in (html, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if p is None else page_text(p) for p in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "__text"])

    source = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(html).cast("string").alias("__html"))
    done = source.mapInArrow(run, source.drop("__html").schema.add("__text", "string"))
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("__text").alias(out))
