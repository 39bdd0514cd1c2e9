"""HTML extraction by layout-aware rendering.

A tokeniser feeds a tree builder that knows void elements, implied start and
end tags and raw-text elements. The renderer walks the tree and emits all
visible text: blocks stand on lines of their own, paragraphs and headings with
a blank line around them, list items behind a bullet or their number and
indented by their depth, ``pre`` keeps its white space, and the cells of a
table are aligned in columns."""

from __future__ import annotations

import re
from contextvars import ContextVar
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, steps


def _names(s: str) -> frozenset[str]:
    return frozenset(s.split())


VOID = _names("area base br col embed hr img input link meta param source track wbr")
RAW = _names("script style noscript template iframe noframes noembed xmp plaintext")  # content is no markup, or not shown
RCDATA = _names("title textarea")
HIDDEN = _names("head title script style noscript template iframe noframes noembed audio video canvas datalist "
                "annotation annotation-xml")
UNDRAWN = _names("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter")  # within svg
PREFORMATTED = _names("pre textarea xmp plaintext")
BLOCK = _names("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
               "footer form header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
               "table ul h1 h2 h3 h4 h5 h6 caption tr thead tbody tfoot xmp plaintext")
SPACED = _names("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure hr xmp plaintext")  # a blank line before and after
LISTS = _names("ul ol menu dir")
APART = _names("td th text mtr mtd")  # cells outside any table, and what stands apart in drawings and formulas
#: An open element of the second set ends where one of the first starts.
CLOSES = [
    (BLOCK - _names("tr thead tbody tfoot caption"), _names("p")),
    (_names("li"), _names("li")), (_names("dt dd"), _names("dt dd")), (_names("option optgroup"), _names("option")),
    (_names("td th"), _names("td th")), (_names("tr"), _names("td th tr caption colgroup")),
    (_names("thead tbody tfoot"), _names("td th tr thead tbody tfoot caption colgroup")),
]
#: Elements that an implied end tag does not look beyond.
SCOPE = _names("table ul ol dl select html body div td th article section button")
_SCOPE_OF = {"li": _names("ul ol menu dir table"), "dt": _names("dl table"), "dd": _names("dl table"), "td": _names("table"),
             "th": _names("table"), "tr": _names("table"), "thead": _names("table"), "tbody": _names("table"),
             "tfoot": _names("table"), "caption": _names("table"), "colgroup": _names("table"),
             "option": _names("select datalist"), "p": _names("table td th button object")}

#: For each start tag the end tags that it implies, cells first.
_IMPLIED = {tag: [(end, _SCOPE_OF.get(end, SCOPE)) for starts, ends in CLOSES if tag in starts
                  for end in sorted(ends, key=lambda e: (e not in ("td", "th"), e))]
            for tag in frozenset().union(*(starts for starts, _ in CLOSES))}

_TOKEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")  # possessive: read once, never again
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WALLS = _names("table td th")
_TABLE_WALLS = {t: _names("table") for t in "tr td th thead tbody tfoot caption".split()} | {"table": frozenset()}
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def visible(self) -> bool:
        if self.tag in HIDDEN:
            return False
        if not self.attrs:
            return True
        if self.get("hidden") is not None or self.tag == "input":
            return False
        style = self.get("style")
        return not (style and _INVISIBLE.search(style))


class Open:
    """Open elements, with the places of each tag, so that looking for an open
    tag does not walk down a deep tree."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def add(self, child) -> None:
        self.stack[-1].children.append(child)

    def push(self, node: Node) -> None:
        self.add(node)
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else 0

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all within it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def close_tag(self, tag: str, scope: frozenset[str]) -> None:
        """Close the innermost ``tag``, if none of ``scope`` is nearer."""
        place = self.last(tag)
        if place and not any(self.last(s) > place for s in scope):
            self.close(place)


def parse(html: str) -> Node:
    """Tree of a document: nodes and strings."""
    root = Node("#root")
    open_ = Open(root)
    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            open_.add(unescape(html[at:]))
            break
        if m.start() > at:
            open_.add(unescape(html[at:m.start()]))
        at = m.start()
        if m[0] in ("<!--", "<!", "<?"):
            mark = "-->" if m[0] == "<!--" else ">"
            end = html.find(mark, m.end())
            at = size if end < 0 else end + len(mark)
            continue
        m = _NAME.match(html, at)
        tag, start = m[2].lower(), m.end()
        at = _ATTRIBUTES.match(html, start).end()
        if at < size and html[at] != ">":  # a quote that nothing closes: up to the next bracket
            at = html.find(">", at)
            at = size if at < 0 else at
        attrs = html[start:at]
        at += 1
        if m[1]:
            _end(open_, tag)
            continue
        _imply(open_, tag)
        node = Node(tag, attrs)
        if tag in UNDRAWN and open_.last("svg"):
            node.attrs = "hidden " + attrs
        if attrs.endswith("/") and (open_.last("svg") or open_.last("math")):  # only there such a tag ends itself
            open_.add(node)
        elif tag in RAW or tag in RCDATA:
            open_.add(node)
            end = None if tag == "plaintext" else _raw_end(tag).search(html, at)
            stop = end.start() if end else size
            if tag in RCDATA:
                node.children.append(unescape(html[at:stop]))
            elif tag in PREFORMATTED:
                node.children.append(html[at:stop])
            close = html.find(">", stop)
            at = size if close < 0 else close + 1
        elif tag in VOID:
            open_.add(node)
        else:
            open_.push(node)
    return root


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def _imply(open_: Open, tag: str) -> None:
    """End tags that the start of ``tag`` implies, and the row that a cell needs."""
    for end, scope in _IMPLIED.get(tag, ()):
        open_.close_tag(end, scope)
    if tag in ("td", "th") and open_.top.tag in ("table", "thead", "tbody", "tfoot"):
        open_.push(Node("tr"))


def _end(open_: Open, tag: str) -> None:
    """An end tag closes the innermost element of its name, but none outside
    the table or, for other than table tags, the cell that it stands in."""
    if tag == "br":  # </br> is a line break
        open_.add(Node("br"))
        return
    open_.close_tag(tag, _TABLE_WALLS.get(tag, _WALLS))


class Lines:
    """Lines of text under construction, with collapsed white space."""

    def __init__(self):
        self.done: list[str] = []
        self.line, self.blank, self.space = "", False, False
        self.parts: list[str] = []

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            head, *more = s.replace("\r\n", "\n").split("\n")
            self._add(head)
            for x in more:
                self.flush(keep=True)
                self._add(x)
            return
        words = _SPACES.split(s)
        if words[0] == "" and len(words) > 1:
            self.space = bool(self.parts)
        for i, w in enumerate(words):
            if w:
                if i and self.parts:
                    self.space = True
                self._add((" " if self.space and self.parts else "") + w)
                self.space = False
        if words[-1] == "" and len(words) > 1:
            self.space = bool(self.parts)

    def _add(self, s: str) -> None:
        if s:
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            self.parts.append(s)

    def flush(self, keep: bool = False) -> None:
        """End the line; an empty one is only kept within ``pre``."""
        if self.parts or keep:
            self.done.append("".join(self.parts))
        self.parts, self.space = [], False

    def gap(self) -> None:
        self.flush()
        self.blank = True

    def put(self, lines: list[str]) -> None:
        """Lines that were laid out before."""
        self.flush()
        if lines and self.blank and self.done:
            self.done.append("")
        if lines:
            self.blank = False
        self.done += lines

    def result(self) -> list[str]:
        self.flush()
        return self.done


def _layout(root: Node, pre: bool = False, flat: bool = False) -> list[str]:
    """Lines of a node's content. Open elements are on a stack of their own,
    so that deep trees need no deep recursion; only lists, quotes and table
    cells, which are laid out on their own, recurse, unless ``flat``: then
    they are blocks like others, neither indented nor aligned."""
    out = Lines()
    todo: list = [("open", c, pre) for c in reversed(root.children)]
    while todo:
        what, node, pre = todo.pop()
        if what == "close":
            out.gap() if node.tag in SPACED else out.flush()
            continue
        if isinstance(node, str):
            out.text(node, pre)
            continue
        tag = node.tag
        if not node.visible():
            continue
        if tag == "br":
            out.flush(keep=True) if not out.parts else out.flush()
        elif tag == "hr":
            out.gap()
        elif tag == "img":
            alt = node.get("alt")
            if alt:
                out.text(alt)
        elif tag in VOID:
            continue
        elif tag == "table" and not flat:
            out.gap()
            out.put(_table(node))
            out.gap()
        elif tag in LISTS and not flat:
            out.gap() if tag in ("ul", "ol") else out.flush()
            out.put(_list(node))
            out.gap() if tag in ("ul", "ol") else out.flush()
        elif tag in ("blockquote", "dd") and not flat:
            out.gap() if tag in SPACED else out.flush()
            out.put(_indent(_guarded(node), "  "))
            out.gap() if tag in SPACED else out.flush()
        elif tag in BLOCK or tag == "textarea":
            out.gap() if tag in SPACED else out.flush()
            todo.append(("close", node, pre))
            children = _marked(node) if tag in LISTS else node.children
            todo += [("open", c, pre or tag in PREFORMATTED) for c in reversed(children)]
        else:
            if tag in APART:
                out.text(" ")
            children = node.children
            if tag == "mfrac":
                children = [x for c in children for x in (c, " ")][:-1]
            todo += [("open", c, pre) for c in reversed(children)]
    return out.result()


MOST_NESTED = 60  # lists, quotes and tables in each other; deeper ones are indented and aligned no more
_depth = 0


def _guarded(node: Node) -> list[str]:
    global _depth
    if _depth >= MOST_NESTED:
        return _layout(node, flat=True)
    _depth += 1
    try:
        return _layout(node)
    finally:
        _depth -= 1


def _mark(node: Node, number: int) -> str:
    return f"{number}. " if node.tag == "ol" else "- "


def _first_number(node: Node) -> int:
    start = node.get("start") or ""
    return int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1


def _marked(node: Node) -> list:
    """Content of a list, each visible item with its mark before it."""
    out, number = [], _first_number(node)
    for c in node.children:
        if not isinstance(c, str) and c.tag == "li" and c.visible():
            item = Node("li", c.attrs)
            item.children = [_mark(node, number), *c.children]
            number += 1
            c = item
        out.append(c)
    return out


def _indent(lines: list[str], by: str) -> list[str]:
    return [by + x if x else x for x in lines]


def _list(node: Node) -> list[str]:
    out: list[str] = []
    number = _first_number(node)
    loose = Node("#loose")

    def flush_loose():
        if loose.children:
            out.extend(_guarded(loose))
            loose.children = []

    for c in node.children:
        if isinstance(c, str) or c.tag != "li":
            loose.children.append(c)
            continue
        flush_loose()
        if not c.visible():
            continue
        mark = _mark(node, number)
        number += 1
        lines = _guarded(c)
        if lines:
            out.append(mark + lines[0])
            out += _indent(lines[1:], " " * len(mark))
    flush_loose()
    return out


def _rows(node: Node):
    """Rows and captions of a table, and what else stands in it."""
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                yield "text", _part(c)
        elif not c.visible():
            continue
        elif c.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(c)
        elif c.tag == "tr":
            yield "row", c
        elif c.tag not in ("colgroup", "col"):
            yield "text", _part(c)


def _part(child) -> Node:
    n = Node("#part")
    n.children.append(child)
    return n


def _span(cell: Node) -> int:
    v = cell.get("colspan") or ""
    return max(1, min(1000, int(v))) if re.fullmatch(r"\d{1,9}", v) else 1


def _table(node: Node) -> list[str]:
    """Cells aligned in columns, two spaces apart; cells of several lines take
    several lines. Where that would pad a page beyond ``PADDING`` times its
    length, a tab ends each cell of the table instead."""
    before: list[str] = []
    rows: list[list[tuple[int, list[str]]]] = []
    after: list[str] = []
    for kind, n in _rows(node):
        if kind == "text":
            (after if rows else before).extend(_guarded(n))
            continue
        cells = []
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    cells.append((1, _guarded(_part(c))))
            elif c.visible():
                cells.append((_span(c), _guarded(c if c.tag in ("td", "th") else _part(c))))
        rows.append(cells)
    width: list[int] = []
    for cells in rows:
        at = 0
        for span, lines in cells:
            width += [0] * (at + span - len(width))
            if span == 1:
                width[at] = max([width[at], *map(len, lines)])
            at += span
    starts = [0, *accumulate(w + 2 for w in width)]
    out, padding = [], 0
    for cells in rows:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            at = 0
            for span, lines in cells:
                padding += max(0, starts[at + span] - starts[at] - (len(lines[k]) if k < len(lines) else 0))
                at += span
    aligned = padding <= _room.get()[0]
    if aligned:
        _room.get()[0] -= padding
    for cells in rows:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            row, at = [], 0
            for span, lines in cells:
                text = lines[k] if k < len(lines) else ""
                row.append(text.ljust(starts[at + span] - starts[at]) if aligned else text + "\t")
                at += span
            out.append("".join(row).rstrip())
    return before + out + after


# Spaces that the tables of a page may still be padded with: a multiple of its length
_room: ContextVar[list[int]] = ContextVar("room")
PADDING = 4


def render_tree(root: Node, size: int) -> str:
    """Visible text of a document of ``size`` characters."""
    _room.set([PADDING * size + 1000])
    lines = [x.rstrip() for x in _layout(root)]
    return "\n".join(lines).strip("\n")


def render(html: str) -> str:
    """Visible text of an HTML document."""
    return render_tree(parse(html), len(html))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, title`` (text of the first ``title``
    element, else null), ``text, n_chars, n_lines``.

    Null and empty html give an empty text, as does a page of which nothing is
    visible. Broken markup is read as browsers read it as far as the tree
    builder goes. Repeated rows and null ids come back; an empty table gives
    no rows; other columns are not read. Whole pages are read, one pass, no
    shuffle."""
    d = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for part in steps(batch, "html"):
                html = [t.decode("utf-8", "replace") for t in raw_texts(part.column(1))]
                trees = [parse(x) for x in html]
                text = [render_tree(t, len(x)) for t, x in zip(trees, html)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([title(t) for t in trees], pa.string()), pa.array(text, pa.string()),
                     pa.array([len(x) for x in text], pa.int64()),
                     pa.array([x.count("\n") + 1 if x else 0 for x in text], pa.int64())],
                    ["page_id", "title", "text", "n_chars", "n_lines"])

    kind = d.schema["page_id"].dataType.simpleString()
    return d.mapInArrow(run, f"page_id {kind}, title string, text string, n_chars bigint, n_lines bigint")


def title(root: Node) -> str | None:
    """Text of the first ``title`` element that is not part of a drawing."""
    stack = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, str) or n.tag == "svg":
            continue
        if n.tag == "title":
            return " ".join("".join(c for c in n.children if isinstance(c, str)).split())
        stack.extend(reversed(n.children))
    return None
