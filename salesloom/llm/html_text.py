"""Visible text of HTML pages, laid out: block spacing, lists, aligned table cells.

A tag reader feeds a tree builder that keeps the stack of open elements, adds the tags HTML lets authors leave
out and ignores end tags without a start. The renderer follows it with a stack of its own, so nesting is
bound to no recursion. Elements that a browser does not show are skipped.

Rules of the layout: white space collapses, except in ``pre`` and ``textarea``; paragraphs, headings, lists, tables and
the like are set off by an empty line, other blocks by a line break; list items begin with "- " or their number and
indent by their depth; table cells line up in columns two spaces apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.arrow import Collector, map_arrow, small_slices

# Element names and their roles, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style iframe noembed noframes xmp".split())
ESCAPABLE_TEXT = frozenset("title textarea".split())
NOT_SHOWN = frozenset(
    "head title script style template iframe noembed noframes object audio video canvas svg math datalist select area "
    "base link meta param source track".split()
)
SET_OFF = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure menu dir xmp plaintext listing fieldset".split()
)
BLOCK = SET_OFF | frozenset(
    "html body address article aside center details dialog dd div dt figcaption footer form header hgroup hr "
    "legend li main nav noscript optgroup option search section summary caption tr td th thead tbody tfoot".split()
)
CLOSES_P = (BLOCK - frozenset("html body noscript optgroup option tr td th thead tbody tfoot caption legend".split()))
SCOPE_ENDS = frozenset("html table td th caption template object button marquee".split())

#: Start tag -> (open elements it ends, elements beyond which it does not look).
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th caption".split()), frozenset("table tr".split())),
    "th": (frozenset("td th caption".split()), frozenset("table tr".split())),
    **{
        part: (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"]))
        for part in ("thead", "tbody", "tfoot", "caption", "colgroup")
    },
    "body": (frozenset(["head"]), frozenset()),
}

#: Elements are not nested deeper than this; browsers have such a limit too. Further ones become neighbours.
MAX_DEPTH = 512

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_HAS_STYLE = re.compile(r"hidden|style|span|start|value|reversed", re.I)


def _attributes(source: str) -> dict[str, str]:
    """Attributes that bear on layout or visibility; the first of a name counts."""
    found: dict[str, str] = {}
    if source and _HAS_STYLE.search(source):
        for name, *values in _ATTRIBUTE.findall(source):
            found.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return found


class _Tags:
    """Splits a page into events, in time linear in its length."""

    def __init__(self, html: str):
        self._html = html
        self._unclosed: set[str] = set()  # quotes that do not occur again

    def _tag_end(self, at: int) -> int:
        """Where the ``>`` of a tag stands whose attributes begin at ``at``; -1 if there is none. A ``>`` inside a
        quoted value does not count, unless the quote is never closed."""
        html = self._html
        while (mark := _TAG_MARK.search(html, at)) is not None:
            if mark[0] == ">":
                return mark.start()
            at = mark.end()
            if html[max(0, mark.start() - 2) : mark.start()].rstrip()[-1:] == "=":
                close = -1 if mark[0] in self._unclosed else html.find(mark[0], at)
                if close < 0:
                    self._unclosed.add(mark[0])
                else:
                    at = close + 1
        return -1

    def _after_comment(self, at: int) -> int:
        html = self._html
        for short in (">", "->"):
            if html.startswith(short, at):
                return at + len(short)
        ends = [e + n for e, n in ((html.find("-->", at), 3), (html.find("--!>", at), 4)) if e >= 0]
        return min(ends) if ends else len(html)

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name or text, attributes); kinds are text, start, end and raw (text of a raw element). A tag the
        page ends in is dropped."""
        html, at, text_from = self._html, 0, 0
        size = len(html)
        while (at := html.find("<", at)) >= 0:
            end_tag = html.startswith("/", at + 1)
            name = _NAME.match(html, at + 1 + end_tag)
            bogus = html[at + 1 : at + 2] in ("!", "?") or (end_tag and name is None and at + 2 < size)
            if name is None and not bogus:
                at += 1
                continue
            if at > text_from:
                yield "text", html[text_from:at], ""
            if name is None:
                if html.startswith("!--", at + 1):
                    at = self._after_comment(at + 4)
                else:
                    close = html.find(">", at)
                    at = close + 1 if close >= 0 else size
                text_from = at
                continue
            close = self._tag_end(name.end())
            if close < 0:
                return
            tag, at = name[0].lower(), close + 1
            if end_tag:
                yield "end", tag, ""
            else:
                yield "start", tag, html[name.end() : close]
                if tag in RAW_TEXT or tag in ESCAPABLE_TEXT:
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    until = stop.start() if stop else size
                    yield ("text" if tag in ESCAPABLE_TEXT else "raw"), html[at:until], ""
                    at = until
                elif tag == "plaintext":
                    yield "raw", html[at:], ""
                    return
            text_from = at
        if text_from < size:
            yield "text", html[text_from:], ""


@dataclass
class _Flow:
    """Lines of a block of text under way, with the spacing owed before the next word."""

    lines: list[str] = field(default_factory=list)
    line: list[str] = field(default_factory=list)
    space: bool = False
    breaks: int = 0  # line ends owed: 1 for a new line, 2 for an empty line between
    indent: str = ""
    marker: str = ""

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def separate(self, breaks: int) -> None:
        self.end_line()
        self.breaks = max(self.breaks, breaks)

    def _open(self) -> None:
        if not self.line:
            if self.breaks > 1 and self.lines:
                self.lines.append("")
            self.breaks = 0
            if self.marker:
                self.line.append(self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker)
                self.marker = ""
            else:
                self.line.append(self.indent)

    def word(self, text: str) -> None:
        """``text`` with its white space collapsed."""
        flat = _SPACE.sub(" ", text)
        if flat == " ":
            self.space = True
            return
        if flat[:1] == " ":
            self.space, flat = True, flat[1:]
        if not flat:
            return
        empty = not self.line
        self._open()
        if self.space and not empty:
            self.line.append(" ")
        self.space = flat[-1] == " "
        self.line.append(flat[:-1] if self.space else flat)

    def keep(self, text: str) -> None:
        """``text`` as it stands."""
        for i, part in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.hard_break()
            if part:
                self._open()
                self.line.append(part)

    def hard_break(self) -> None:
        if self.line:
            self.end_line()
        elif not self.breaks and self.lines:
            self.lines.append("")

    def block(self, lines: list[str]) -> None:
        """Finished lines, such as a table's."""
        for text in lines:
            self._open()
            self.line.append(text)
            self.end_line()

    def finished(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


@dataclass
class _Table:
    outer: _Flow
    rows: list[list[tuple[list[str], int]]] = field(default_factory=list)
    captions: list[str] = field(default_factory=list)
    down: dict[int, int] = field(default_factory=dict)  # column -> rows still covered from above

    def row(self) -> None:
        self.down = {c: n - 1 for c, n in self.down.items() if n > 1}
        self.rows.append([])

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        column = sum(n for _, n in row)
        while column in self.down:
            row.append(([], 1))
            column += 1
        row.append((lines, across))
        if down > 1:
            for c in range(column, column + across):
                self.down[c] = down

    def drawn(self) -> list[str]:
        """Captions, then rows with cells padded to their column; a cell over several columns sets no width."""
        widths: dict[int, int] = {}
        for row in self.rows:
            column = 0
            for lines, across in row:
                if across == 1:
                    widths[column] = max(widths.get(column, 0), *map(len, lines), 0)
                column += across
        used = [c for c in sorted(widths) if widths[c]]
        out = list(self.captions)
        for row in self.rows:
            height = max((len(lines) for lines, _ in row), default=0)
            for i in range(height):
                text, column, start = "", 0, 0
                for lines, across in row:
                    here = [c for c in used if column <= c < column + across]
                    part = lines[i] if i < len(lines) else ""
                    if part:
                        text = text.ljust(start)
                        text += ("  " if text and not text.endswith("  ") and len(text) >= start else "") + part
                    start += sum(widths[c] + 2 for c in here)
                    column += across
                out.append(text.rstrip(" "))
        while out and not out[-1]:
            out.pop()
        return out


@dataclass
class _Open:
    name: str
    hidden: bool
    numbers: list[int] | None = None  # of an ordered list: next number and step
    span: tuple[int, int] = (1, 1)
    table: _Table | None = None
    flow: _Flow | None = None  # the flow that goes on after this element
    indent: str | None = None


def _int(text: str | None, default: int, least: int, most: int) -> int:
    found = re.match(r"\s*(-?\d{1,9})", text or "")
    return min(most, max(least, int(found[1]))) if found else default


class _Renderer:
    """Tree builder and layout in one pass over the events."""

    def __init__(self) -> None:
        self.flow = _Flow()
        self.stack: list[_Open] = []
        self.open: dict[str, int] = {}  # how many of a name are open
        self.kept = 0  # open elements that keep white space

    def text(self, text: str) -> None:
        if self.stack and self.stack[-1].hidden:
            return
        if self.kept:
            self.flow.keep(text)
        else:
            self.flow.word(text)

    def start(self, name: str, source: str) -> None:
        attributes = _attributes(source)
        ends = IMPLIED_ENDS.get(name)
        if ends:
            self._end_up_to(*ends)
        if name in CLOSES_P and self.open.get("p"):
            self._end_up_to(frozenset(["p"]), SCOPE_ENDS)
        if name in ("td", "th") and self._nearest("table", "tr") == "table":
            self.start("tr", "")
        shown = not (self.stack and self.stack[-1].hidden)
        hidden = (
            not shown
            or name in NOT_SHOWN
            or "hidden" in attributes
            or bool(attributes.get("style")) and bool(_HIDDEN_STYLE.search(attributes["style"].lower()))
        )
        if name in VOID:
            if not hidden:
                if name == "br":
                    self.flow.hard_break()
                elif name == "hr":
                    self.flow.separate(2)
            return
        if len(self.stack) >= MAX_DEPTH:
            self._pop()
        element = _Open(name, hidden)
        if not hidden:
            self._enter(element, attributes)
        self.stack.append(element)
        self.open[name] = self.open.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name == "p" and not self.open.get("p"):
            self.start("p", "")
        if name == "br":
            self.start("br", "")
            return
        if not self.open.get(name):
            return
        # an end tag does not reach out of a cell or caption, unless it ends the table or a part of it
        walls = frozenset() if name in SCOPE_ENDS or name in ("tr", "thead", "tbody", "tfoot") else frozenset("td th caption".split())
        self._end_up_to(frozenset([name]), walls)

    def _nearest(self, *names: str) -> str | None:
        if not any(self.open.get(n) for n in names):
            return None
        return next((e.name for e in reversed(self.stack) if e.name in names), None)

    def _end_up_to(self, names: frozenset[str], walls: frozenset[str]) -> None:
        """End the outermost open element of ``names`` that no wall hides, with all inside it."""
        if not any(self.open.get(n) for n in names):
            return
        depth = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name in names:
                depth = i
                if len(names) == 1:
                    break
            elif self.stack[i].name in walls:
                break
        while depth is not None and len(self.stack) > depth:
            self._pop()

    def _enter(self, element: _Open, attributes: dict[str, str]) -> None:
        name, flow = element.name, self.flow
        if name in ("td", "th"):
            across = _int(attributes.get("colspan"), 1, 1, 1000)
            element.span = (across, _int(attributes.get("rowspan"), 1, 0, 65534) or 65534)
            element.flow, self.flow = flow, _Flow()
            return
        if name == "caption" and self._table() is not None:
            element.flow, self.flow = flow, _Flow()
            return
        if name == "tr":
            table = self._table()
            if table is not None:
                table.row()
                return
        if name in ("thead", "tbody", "tfoot") and self._table() is not None:
            return
        if name in BLOCK:
            nested = name in ("ul", "ol", "menu", "dir") and any(self.open.get(n) for n in ("ul", "ol", "menu", "dir"))
            flow.separate(2 if name in SET_OFF and not nested else 1)
        if name == "table":
            element.table = _Table(flow)
            element.flow, self.flow = flow, _Flow()  # text between cells is shown before the table
        elif name in ("ul", "ol", "menu", "dir"):
            step = -1 if "reversed" in attributes else 1
            if name == "ol":
                element.numbers = [_int(attributes.get("start"), 1, -(10**9), 10**9), step]
        elif name == "li":
            marker = "- "
            around = next((e for e in reversed(self.stack) if e.name in ("ul", "ol", "menu", "dir")), None)
            if around is not None and around.numbers:
                around.numbers[0] = _int(attributes.get("value"), around.numbers[0], -(10**9), 10**9)
                marker = f"{around.numbers[0]}. "
                around.numbers[0] += around.numbers[1]
            element.indent = flow.indent
            flow.indent += " " * len(marker)
            flow.marker = marker
        elif name in ("blockquote", "dd"):
            element.indent = flow.indent
            flow.indent += "  "
        elif name in ("pre", "textarea", "listing", "xmp", "plaintext"):
            self.kept += 1

    def _table(self) -> _Table | None:
        """The innermost open table, if no cell or hidden element lies between."""
        for element in reversed(self.stack):
            if element.name in ("td", "th", "caption") or element.hidden:
                return None
            if element.table is not None:
                return element.table
        return None

    def _pop(self) -> None:
        element = self.stack.pop()
        name = element.name
        self.open[name] -= 1
        if element.hidden:
            return
        if element.table is not None:
            between, outer = self.flow.finished(), element.flow
            outer.block(between)
            outer.block(element.table.drawn())
            self.flow = outer
        elif element.flow is not None:
            lines, self.flow = self.flow.finished(), element.flow
            table = self._table()
            if table is None:  # a cell outside a table is a block
                self.flow.separate(1)
                self.flow.block(lines)
            elif name == "caption":
                table.captions.extend(lines)
            else:
                table.cell(lines, *element.span)
            return
        if element.indent is not None:
            self.flow.end_line()
            self.flow.indent, self.flow.marker = element.indent, ""
        if name in ("pre", "textarea", "listing", "xmp", "plaintext"):
            self.kept -= 1
        if name in BLOCK and not (name in ("tr", "thead", "tbody", "tfoot") and self._table() is not None):
            nested = name in ("ul", "ol", "menu", "dir") and any(self.open.get(n) for n in ("ul", "ol", "menu", "dir"))
            self.flow.separate(2 if name in SET_OFF and not nested else 1)

    def finished(self) -> str:
        while self.stack:
            self._pop()
        return "\n".join(self.flow.finished())


def visible_text(html: str | None) -> str:
    """The text a reader would see, laid out; empty for null."""
    page = _Renderer()
    for kind, value, attributes in _Tags(html or ""):
        if kind == "text":
            page.text(unescape(value) if "&" in value else value)
        elif kind == "raw":
            page.text(value)
        elif kind == "start":
            page.start(value, attributes)
        else:
            page.end(value)
    return page.finished()


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text of every row of ``pages`` (page_id, html): the whole visible text.

    A null or empty html gives an empty text. Rows are rendered one by one, so repeated rows and null ids stay; columns besides
    page_id and html are ignored; an empty table gives no rows.
    """
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Collector(schema)
        for part in small_slices(batches):
            for page_id, html in zip(part["page_id"].to_pylist(), part["html"].to_pylist()):
                text = visible_text(html)
                if out.add((page_id, text), 2 * len(text) + 16):
                    yield out.take()
        yield out.take()

    return map_arrow(pages.select(F.col("page_id").cast("long"), "html"), run, "page_id long, text string")
