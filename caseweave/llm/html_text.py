"""Layout-aware text of web pages: a tree with implied tags, visibility rules, and a renderer for blocks, lists and tables."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("area base datalist embed head link meta noembed noframes noscript param script source style template title track object audio video canvas iframe".split())
# Inside svg and math: what is not shown, where text is shown, what holds HTML, and the HTML tags that end them.
FOREIGN_HIDDEN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter style script".split()),
    "math": frozenset("annotation annotation-xml mphantom style script".split()),
}
SVG_TEXT = frozenset("text tspan textpath tref a foreignobject".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu pre table fieldset figure hr".split())
BLOCK = PARAGRAPH | frozenset(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main nav "
    "optgroup option search section summary tbody td tfoot th thead tr".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("body caption dd dt html legend li option optgroup summary tbody td tfoot th thead tr".split())
# A start tag closes these open elements, as far up as the boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th", "caption"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th", "caption"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th", "caption"}),
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
# Any other start tag, or text, ends an open head.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_SECTIONS = frozenset({"thead", "tbody", "tfoot"})
# A part of an open table goes back to the table, as far down as these.
TABLE_PARTS = {
    **dict.fromkeys(("caption", "colgroup", *_SECTIONS), frozenset()),
    "col": frozenset({"colgroup"}), "tr": _SECTIONS, "td": _SECTIONS | {"tr"}, "th": _SECTIONS | {"tr"},
}
# What these hold besides their parts stands before the table.
NO_CONTENT = frozenset({"table", "tr", "colgroup"}) | _SECTIONS
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    """``space``: svg or math for these elements and the elements of theirs inside, empty for HTML."""

    __slots__ = ("tag", "attrs", "children", "space")

    def __init__(self, tag: str, attrs: dict[str, str | None], space: str = ""):
        self.tag, self.attrs, self.children, self.space = tag, attrs, [], space


class TreeBuilder(HTMLParser):
    """Open elements as a stack; start tags close what they imply, unmatched end tags are passed over.

    Text and elements between the parts of a table stand before it, as in a browser.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def _close(self, tags: set[str], boundary: set[str]) -> None:
        at = len(self.open) - 1
        last = None
        while at > 0 and self.open[at].tag not in boundary and self.open[at].tag != "template":
            if self.open[at].tag in tags:
                last = at
            at -= 1
        if last is not None:
            del self.open[last:]

    def _table(self, stops: tuple[str, ...] = ()) -> int:
        """Place of the innermost open table, 0 for none on this side of a template or of ``stops``."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == "table":
                return at
            if self.open[at].tag == "template" or self.open[at].tag in stops:
                return 0
        return 0

    def _append(self, child: Node | str) -> None:
        at = self._table() if self.open[-1].tag in NO_CONTENT else 0
        if at:
            # An open table is the last child of the element below it on the stack.
            self.open[at - 1].children.insert(-1, child)
        else:
            self.open[-1].children.append(child)

    def _table_part(self, tag: str, node: Node, at: int) -> None:
        keep = at + 1
        while keep < len(self.open) and self.open[keep].tag in TABLE_PARTS[tag]:
            keep += 1
        del self.open[keep:]
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            row = Node("tr", {})
            self.open[-1].children.append(row)
            self.open.append(row)
        self.open[-1].children.append(node)

    def _space(self) -> str:
        """Whose elements the innermost open one holds."""
        return "" if self.open[-1].tag in HOLDS_HTML else self.open[-1].space

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_FOREIGN or (tag == "font" and not {"color", "face", "size"}.isdisjoint(dict(attrs))):
            while self._space():
                self.open.pop()
        space = tag if tag in ("svg", "math") else self._space()
        if space and space != tag:
            self.open.append(Node(tag, dict(attrs), space))
            self.open[-2].children.append(self.open[-1])
            return
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.open.pop()
        node = Node(tag, dict(attrs), space)
        if tag in TABLE_PARTS and (at := self._table()):
            self._table_part(tag, node, at)
        else:
            if tag == "form" and self.open[-1].tag in NO_CONTENT and self._table():
                return  # a form between the parts of a table holds nothing
            if tag == "table" and (at := self._table(("td", "th", "caption"))):
                del self.open[at:]
            if tag in ENDS_PARAGRAPH and any(n.tag == "p" for n in self.open):
                self._close({"p"}, {"table", "td", "th", "li", "button", "object", "caption"})
            if tag in IMPLIED:
                self._close(*IMPLIED[tag])
            self._append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        # Only elements of svg and math can end in their start tag.
        if self.open[-1].space and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in VOID and not self._space():
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return
            if tag == "template":
                continue
            # The end tag of a part does not reach out of its table, any other but the table's own not out of a cell.
            if self.open[at].tag in ("table", "template") or (self.open[at].tag in ("td", "th", "caption") and tag not in TABLE_PARTS and tag != "table"):
                return

    def handle_data(self, data):
        if data.strip(" \t\n\r\f"):
            if self.open[-1].tag == "head":
                self.open.pop()
            self._append(data)
        else:
            self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    attrs = node.attrs
    if node.space:
        if node.tag in FOREIGN_HIDDEN[node.space] or attrs.get("display") == "none" or attrs.get("visibility") in ("hidden", "collapse"):
            return False
        return not _INVISIBLE.search(attrs.get("style") or "")
    if node.tag in HIDDEN or "hidden" in attrs or (node.tag == "input" and (attrs.get("type") or "").lower() == "hidden"):
        return False
    if node.tag == "dialog" and "open" not in attrs:
        return False
    return not _INVISIBLE.search(attrs.get("style") or "")


def width(text: str) -> int:
    """Columns on a fixed-width screen."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of text: collapsed white space, at most one blank line between blocks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a blank line is due before the next text
        self.space = False  # a space is due before the next word of the line
        self.prefix: list[str] = []
        self.marker: str | None = None

    def _start(self) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            indent = "".join(self.prefix)
            if self.marker is not None:
                indent = "".join(self.prefix[:-1]) + self.marker
                self.marker = None
            self.line = [indent]
            self.space = False

    def text(self, value: str) -> None:
        words = _SPACES.split(value)
        if len(words) > 1 and not words[0]:
            self.space = True
        inner = [w for w in words if w]
        if inner:
            due = self.space and bool(self.line)
            self._start()
            self.line.append((" " if due else "") + " ".join(inner))
            self.space = False
        if len(words) > 1 and not words[-1]:
            self.space = True

    def whole(self, line: str) -> None:
        """A line that keeps its white space."""
        self._start()
        self.line.append(line)
        self.end()

    def end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def blank(self) -> None:
        self.end()
        self.gap = True


def _cells(table: Node) -> tuple[list[Node], list[tuple[int, list[Node]]]]:
    """Captions, and rows of cells with the number of their section; rows of nested tables belong to them."""
    captions, rows, section = [], [], 0
    todo = [*reversed(table.children)]
    while todo:
        node = todo.pop()
        if node is None:
            section += 1
        elif isinstance(node, str) or not visible(node):
            continue
        elif node.tag == "caption":
            captions.append(node)
        elif node.tag == "tr":
            rows.append((section, [c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)]))
        elif node.tag in _SECTIONS:
            section += 1
            todo.append(None)
            todo.extend(reversed(node.children))
    return captions, rows


def _span(cell: Node, name: str = "colspan", most: int = 1000) -> int:
    value = cell.attrs.get(name) or ""
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _places(rows: list[tuple[int, list[Node]]]) -> list[list[int]]:
    """Column of every cell: the first one that no cell of a row above reaches down to, in the same section."""
    out, taken, last = [], {}, None
    for section, cells in rows:
        if section != last:
            taken, last = {}, section
        row, at = [], 0
        below = {k: n - 1 for k, n in taken.items() if n > 1}
        for cell in cells:
            while at in taken:
                at += 1
            row.append(at)
            down = 1 << 30 if (cell.attrs.get("rowspan") or "").strip("0") == "" and cell.attrs.get("rowspan") else _span(cell, "rowspan", 65534)
            for k in range(at, at + _span(cell)):
                if down > 1:
                    below[k] = max(below.get(k, 0), down - 1)
            at += _span(cell)
        out.append(row)
        taken = below
    return out


def _table_lines(rows: list[list[list[str]]], spans: list[list[int]], places: list[list[int]]) -> list[str]:
    """Cells as columns of equal width, two spaces between; a cell of several lines makes its row as high.

    A cell over several columns widens none of them. A cell over several rows stands in its first.
    """
    widths: dict[int, int] = {}
    for cells, span, place in zip(rows, spans, places):
        for lines, n, at in zip(cells, span, place):
            if n == 1:
                widths[at] = max([widths.get(at, 0), *map(width, lines)])
    out = []
    for cells, span, place in zip(rows, spans, places):
        for i in range(max([0, *map(len, cells)])):
            line, at, column = "", 0, 0
            for lines, n, start in zip(cells, span, place):
                column += sum(widths.get(k, 0) + 2 for k in range(at, start))
                line += " " * max(0, column - width(line))
                line += lines[i] if i < len(lines) else ""
                column = max(column + sum(widths.get(k, 0) + 2 for k in range(start, start + n)), width(line) + 2 if n > 1 else 0)
                at = start + n
            out.append(line.rstrip())
    return out


_ENTER, _LEAVE, _TABLE = 0, 1, 2


def _render(root: Node, page: Page) -> None:
    """Walk the tree with a stack of its own, so that deep nesting is no limit."""
    todo: list = [(_ENTER, root, False)]
    lists: list[list] = []
    while todo:
        step, node, pre = todo.pop()
        if isinstance(node, str):
            if pre:
                for i, line in enumerate(node.split("\n")):
                    if i:
                        page.end() if page.line else page.lines.append("")
                    if line.strip("\r"):
                        page._start()
                        page.line.append(line.strip("\r"))
            else:
                page.text(node)
            continue
        tag = node.tag
        if node.space:
            # Labels and cells are set apart by their places.
            page.space = page.space or tag in ("text", "foreignobject", "mtd")
            if step == _ENTER and visible(node):
                shown = node.space == "math" or tag in SVG_TEXT
                todo.append((_LEAVE, node, pre))
                todo.extend((_ENTER, child, pre) for child in reversed(node.children) if shown or isinstance(child, Node))
            continue
        if step == _LEAVE:
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                page.prefix.pop()
            elif tag == "li":
                page.marker = None
                if not lists:
                    page.prefix.pop()
            elif tag in ("blockquote", "dd"):
                page.prefix.pop()
            if tag in PARAGRAPH and not (tag in ("ul", "ol", "menu") and lists):
                page.blank()
            elif tag in BLOCK:
                page.end()
            continue
        if not visible(node):
            continue
        if tag == "br":
            if page.line:
                page.end()
            elif page.lines and not page.gap:
                page.lines.append("")
            continue
        if tag == "hr":
            page.blank()
            page.whole("---")
            page.blank()
            continue
        if tag == "input":
            if (node.attrs.get("type") or "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number"):
                page.text(node.attrs.get("value") or "")
            continue
        if tag == "table":
            page.blank()
            _render_table(node, page)
            page.blank()
            continue
        if tag in PARAGRAPH and not (tag in ("ul", "ol", "menu") and lists):
            page.blank()
        elif tag in BLOCK:
            page.end()
        if tag in ("ul", "ol", "menu"):
            start = node.attrs.get("start") or "1"
            lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start, re.A) else 1])
            page.prefix.append("  ")
        elif tag == "li":
            if lists:
                kind = lists[-1]
                page.marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                page.prefix[-1] = " " * len(page.marker)
            else:
                page.prefix.append("  ")
                page.marker = "- "
        elif tag == "blockquote":
            page.prefix.append("> ")
        elif tag == "dd":
            page.prefix.append("    ")
        todo.append((_LEAVE, node, pre))
        inner = pre or tag in ("pre", "textarea", "listing")
        # A closed details element shows its summary only.
        children = node.children
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        todo.extend((_ENTER, child, inner) for child in reversed(children))
    page.end()


def _render_table(table: Node, page: Page, depth: int = 0) -> None:
    captions, rows = _cells(table)
    for caption in captions:
        inner = Page()
        _render(_content(caption), inner)
        for line in inner.lines:
            page.whole(line)
    texts, spans = [], []
    for _, row in rows:
        cells = []
        for cell in row:
            inner = Page()
            _render(_content(cell), inner)
            # Blank lines stay between others only.
            full = [i for i, line in enumerate(inner.lines) if line]
            cells.append(inner.lines[full[0] : full[-1] + 1] if full else [])
        texts.append(cells)
        spans.append([_span(cell) for cell in row])
    # A table of one column is layout: its cells follow each other as blocks.
    for line in _table_lines(texts, spans, _places(rows)):
        page.whole(line)


def _content(node: Node) -> Node:
    inner = Node("#cell", {})
    inner.children = node.children
    return inner


def html_text(html: str | None) -> str:
    """Visible text of a page; nested tables deeper than the interpreter's stack are given as plain blocks."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    page = Page()
    try:
        _render(builder.root, page)
    except RecursionError:
        page = Page()
        _flatten_tables(builder.root)
        _render(builder.root, page)
    return "\n".join(page.lines).strip("\n")


def _flatten_tables(root: Node) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        node.tag = "div" if node.tag == "table" else node.tag
        todo.extend(c for c in node.children if isinstance(c, Node))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of every page.

    Hidden elements are left out; blocks are lines, paragraphs set off by a blank line, lists indented with markers,
    table cells aligned in columns. Null or empty html gives an empty text with no lines. Repeated rows stay; an empty table
    stays empty; other columns are ignored.
    """
    source = pages.select("page_id", F.col("html").cast("string").alias("html"))
    schema = T.StructType([
        source.schema["page_id"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_lines", T.LongType()),
    ])

    def extract(batches):
        for batch in batches:
            texts = [html_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
            ], names=schema.names)

    return source.mapInArrow(extract, schema)
