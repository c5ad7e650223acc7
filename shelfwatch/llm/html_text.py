"""Layout-aware text of HTML pages.

A tolerant tree builder (implied end tags, elements without end tags, raw-text elements, unmatched end tags, table
parts that clear the stack back to their table) and a renderer that emits all visible text.  Both work on explicit
stacks, so nesting has no limit, and both look up open elements by name, so an unmatched tag costs no walk.

Layout: paragraphs, headings, lists and tables are set apart by a blank line, other blocks by line breaks; list items
have a mark and their further lines are indented below it; cells of a table are aligned in columns; preformatted text
keeps its spaces and lines.  ``<br><br>`` is a blank line.

Visibility: not rendered are head, scripts, ``noscript`` (pages are shown as where scripts run), styles, templates, comments, replaced elements' fallback, closed dialogs,
what a closed ``details`` holds besides its summary, drawings but for their text, and elements whose inline style ends
in ``display: none`` or which have the attribute ``hidden`` without a ``display`` of their own.  ``visibility`` is
inherited and a descendant may turn it on again: invisible text isn't written, but its cell keeps its column.  Form
fields' values and images' alternatives aren't text.

Blanks that alignment puts in are bounded, so output grows with the input and not with cells times lines: a column is
as wide as its widest line of at most ``CELL`` characters (longer ones run over), a column begins at ``ALIGN``
characters at most, half of that inside a cell, a quarter two tables deep and so on, and lists indent a quarter of
that.  So a line has less than 3 * ALIGN blanks of layout.  Where nothing of it is left (eight tables deep) the cells
of a row follow one another.  A line that continues a cell begins at its column; separators are written between texts,
and after the last cell of a row if the table has columns further on.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_slices, utf8_view, with_columns_replaced

OUT_BYTES = 4 << 20
ALIGN = 160
CELL = 40

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HEAD = frozenset("base link meta noframes noscript script style template title".split())
HIDDEN = HEAD | frozenset("head iframe noembed area datalist object audio video canvas rp param".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre listing xmp plaintext textarea figure hr form fieldset".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address li dt dd figcaption caption center details summary legend optgroup option tr td th thead tbody tfoot dialog search hgroup".split())
CLOSES_P = BLOCK - frozenset("html body caption option optgroup legend figcaption textarea tr td th thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PREFORMATTED = frozenset("pre listing xmp plaintext textarea".split())
LISTS = frozenset("ul ol menu dir".split())
GROUPS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
#: An element on the left ends open elements named on the right, unless one named last is nearer.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}), "dt": ({"dt", "dd"}, {"dl", "td", "th", "table"}), "dd": ({"dt", "dd"}, {"dl", "td", "th", "table"}),
           "option": ({"option"}, {"select", "optgroup", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"})}
#: Parts of a table and what they may stand in: the nearest of these becomes the current element.
PARENTS = {"tr": GROUPS | {"table"}, "td": GROUPS | {"table", "tr"}, "th": GROUPS | {"table", "tr"}, **dict.fromkeys([*GROUPS, "caption", "colgroup", "col"], {"table"})}
#: End tags and implied ends don't reach beyond these, unless they are their own.
FENCES = frozenset("table td th caption".split())
INLINE_DISPLAY = frozenset("inline inline-block inline-flex inline-grid contents".split())
BLOCK_DISPLAY = frozenset("block flex grid flow-root list-item table".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)", re.S)
#: The rest of a start tag up to its ``>``, which quotes hide; without one, up to the next ``>`` of any kind.
REST, BARE_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"), re.compile(r"([^>]*)(?:>|\Z)")
MARKS = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
BLANKS = re.compile(r"[ \t\n\r\f]+")
LINE_ENDS = re.compile(r"\r\n?")
WHITE = " \t\n\r\f"


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; of repeated names the first counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def declarations(style: str) -> dict[str, str]:
    """Properties of an inline style: the last counts, an important one before others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in style.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = value.endswith("important") and "!" in value
        if colon and (important or not found.get(name, (False, ""))[0]):
            found[name] = important, value.rpartition("!")[0].strip() if important else value
    return {k: v for k, (_, v) in found.items()}


class Node:
    """An element: shown is whether it is rendered at all, visible whether its own text can be seen."""

    __slots__ = ("tag", "attrs", "children", "shown", "visible", "block")

    def __init__(self, tag: str, raw: str = "", visible: bool = True):
        self.tag, self.children, self.visible = tag, [], visible
        self.attrs = attributes(raw) if raw and not raw.isspace() else {}
        self.shown, self.block = tag not in HIDDEN, tag in BLOCK
        if tag == "dialog" and "open" not in self.attrs:
            self.shown = False
        if self.attrs:
            style = declarations(self.attrs["style"]) if "style" in self.attrs else {}
            display = style.get("display")
            if display == "none" or ("hidden" in self.attrs and (display is None or display in ("inherit", "initial"))) or (tag == "input" and self.attrs.get("type", "").strip().lower() == "hidden"):
                self.shown = False
            if display in INLINE_DISPLAY and tag not in PREFORMATTED:
                self.block = False
            elif display in BLOCK_DISPLAY:
                self.block = True
            seen = style.get("visibility")
            if seen in ("hidden", "collapse"):
                self.visible = False
            elif seen in ("visible", "initial"):
                self.visible = True

    def number(self, name: str, most: int) -> int | None:
        m = re.match(r"\s*(-?\d{1,9})", self.attrs.get(name, ""))
        return None if m is None else min(int(m[1]), most)


class _Builder:
    """The stack of open elements, and for each name where in it elements of that name are."""

    def __init__(self):
        self.root = Node("html")
        self.stack, self.at = [self.root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, size: int) -> None:
        """Close elements until size are open."""
        for node in reversed(self.stack[size:]):
            self.at[node.tag].pop()
        del self.stack[size:]

    def last(self, names) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, names, fence) -> None:
        """End the innermost of names unless one of fence is nearer."""
        k = self.last(names)
        if k and k > self.last(fence):
            self.cut(k)

    def close_all(self, names, fence) -> None:
        """End all of names that are nearer than every one of fence."""
        f, found = self.last(fence), []
        for n in names:
            places = self.at.get(n, ())
            i = bisect_right(places, f)
            if i < len(places):
                found.append(places[i])
        if found:
            self.cut(min(found))

    def text(self, s: str, verbatim: bool = False) -> None:
        top = self.stack[-1]
        if top.tag == "head":
            if not s.strip(WHITE):
                return
            self.cut(len(self.stack) - 1)
            top = self.stack[-1]
        if top.shown and top.visible:
            top.children.append(unescape(s) if "&" in s and not verbatim else s)

    def end(self, name: str) -> None:
        if name == "br":
            self.stack[-1].children.append(Node("br"))
        elif name in HEADINGS:
            self.close(HEADINGS, FENCES)
        elif name in ("td", "th"):
            self.close({name}, {"table"})
        elif name in PARENTS or name == "table":
            self.close({name}, {"table"} - {name})
        else:
            self.close({name}, FENCES | LISTS if name == "li" else FENCES)

    def start(self, name: str, raw: str) -> Node | None:
        """The element of a start tag, put in its place; None where the tag makes none."""
        drawing = self.last(("svg", "math"))
        foreign = drawing > self.last(("foreignobject", "desc", "annotation-xml"))
        if foreign and name in BLOCK | {"b", "i", "em", "strong", "span", "br", "img", "small", "sub", "sup", "code", "u"}:
            self.cut(drawing)
            foreign = False
        if name in ("html", "body"):
            own = Node(name, raw, self.root.visible)
            if name == "body":
                self.close({"head"}, ())
            self.root.shown &= own.shown
            self.root.visible = own.visible
            return None
        if name == "head" and (len(self.stack) > 1 or self.root.children):
            return None
        if self.stack[-1].tag == "head" and name not in HEAD:
            self.cut(len(self.stack) - 1)
        if name in PARENTS and self.at.get("table"):
            self.cut(self.last(PARENTS[name]) + 1)
        elif name in CELLS or name == "tr":
            self.close_all({"td", "th"} | ({"tr"} if name == "tr" else set()), {"table"})
        elif name in IMPLIED:
            self.close_all(*IMPLIED[name])
        if name in CLOSES_P:
            self.close({"p"}, FENCES)
        if name in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.cut(len(self.stack) - 1)
        top = self.stack[-1]
        node = Node(name, raw.rstrip("/") if foreign or name in ("svg", "math") else raw, top.visible)
        top.children.append(node)
        closed = (foreign or name in ("svg", "math")) and raw.endswith("/")
        in_table = name == "form" and top.tag in GROUPS | {"table", "tr"}
        if name not in VOID and not closed and not in_table:
            self.push(node)
        return node


class _Rests:
    """The rests of a page's start tags, in linear time: once a search to the page's end has found no ``>`` outside quotes,
    whether one follows is known for every place from one pass from right to left."""

    def __init__(self, html: str):
        self.html, self.marks, self.close = html, None, None

    def _learn(self) -> None:
        """For each mark, where the ``>`` is that ends a tag whose rest comes to that mark outside quotes, -1 if there is none."""
        self.marks = [m.start() for m in MARKS.finditer(self.html)]
        n = len(self.marks)
        self.close = [-1] * (n + 1)
        after = {'"': -1, "'": -1}  # inside quotes of a kind: what the next mark of that kind leads to
        for k in range(n - 1, -1, -1):
            sign = self.html[self.marks[k]]
            if sign == ">":
                self.close[k] = self.marks[k]
            else:
                self.close[k], after[sign] = after[sign], self.close[k + 1]

    def at(self, place: int) -> tuple[str, int]:
        """(raw attributes, where the tag ends) of the rest that begins at place."""
        if self.marks is None:
            m = REST.match(self.html, place)
            if m:
                return m[1], m.end()
            self._learn()
        end = self.close[bisect_left(self.marks, place)]
        if end >= 0:
            return self.html[place:end], end + 1
        m = BARE_REST.match(self.html, place)
        return m[1], m.end()


def parse(html: str) -> Node:
    """The tree of a page: nodes and strings."""
    build, rests = _Builder(), _Rests(html)
    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            build.text(html[at:])
            break
        if m.start() > at:
            build.text(html[at: m.start()])
        at = m.end()
        if m[1]:
            build.end(m[1].lower())
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        raw, at = rests.at(at)
        if name == "image":
            name = "img"
        node = build.start(name, raw)
        if node is None or build.stack[-1] is not node:
            continue
        if name in PREFORMATTED and html.startswith(("\n", "\r\n"), at):
            at += 1 + html.startswith("\r", at)
        if name == "plaintext":
            build.text(html[at:], verbatim=True)
            break
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else size
            if stop > at and node.shown:
                build.text(html[at:stop], verbatim=name not in ("textarea", "title"))
            build.cut(len(build.stack) - 1)
            gt = html.find(">", stop) if end else -1
            at = gt + 1 if gt >= 0 else size
    return build.root


class _Out:
    """Lines of a page or a cell. None stands for a gap, a blank line between blocks that merges with others."""

    def __init__(self, align: int):
        self.lines: list[str | None] = []
        self.held: list[str] = []
        self.starts = [0]  # of containers whose first and last gaps don't count
        self.marks: list[tuple[int, str]] = []  # of list items that have no line yet, with the indent they stand at
        self.indents = [0]
        self.align, self.pre = align, 0

    def line(self, text: str) -> None:
        if not text and not self.marks:
            self.lines.append("")
            return
        marks = "".join(m for _, m in self.marks)
        indent = min(self.marks[0][0] if self.marks else self.indents[-1], self.align // 4)
        self.marks = []
        self.lines.append((" " * indent + marks + text).rstrip(WHITE))

    def flush(self) -> None:
        if not self.held:
            return
        parts = "".join(self.held).split("\n")
        self.held = []
        if not parts[-1].strip(" "):
            parts.pop()
        for part in parts:
            self.line(part.rstrip(WHITE) if self.pre else BLANKS.sub(" ", part).strip(" "))

    def gap(self) -> None:
        self.flush()
        if not self.marks and len(self.lines) > self.starts[-1] and self.lines[-1] is not None:
            self.lines.append(None)

    def open(self, indent: int = 0, mark: str | None = None) -> None:
        self.flush()
        self.starts.append(len(self.lines))
        if mark is not None:
            self.marks.append((self.indents[-1], mark))
        self.indents.append(self.indents[-1] + indent)

    def close(self, mark: bool = False) -> None:
        self.flush()
        if mark and self.marks:  # an item without text
            self.line("")
        start = self.starts.pop()
        self.indents.pop()
        while len(self.lines) > start and self.lines[-1] is None:
            self.lines.pop()


class _Renderer:
    """Walks a tree in document order: todo holds what comes next, the next last."""

    def __init__(self):
        self.out = _Out(ALIGN)
        self.outer: list[_Out] = []
        self.drawn = [False]  # inside a drawing, but not in its text

    def run(self, root: Node) -> list[str | None]:
        todo: list = [root] if root.shown else []
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                if not self.drawn[-1]:
                    self.out.held.append(LINE_ENDS.sub("\n", item) if self.out.pre else BLANKS.sub(" ", item))
            elif isinstance(item, Node):
                if item.shown:
                    self.enter(item, todo)
            else:
                item()
        self.out.flush()
        return self.out.lines

    def enter(self, node: Node, todo: list) -> None:
        out, tag = self.out, node.tag
        if tag == "br":
            out.held.append("\n")
        elif tag in ("svg", "text", "foreignobject") and (tag == "svg" or len(self.drawn) > 1):
            self.drawn.append(tag == "svg")
            todo += [" ", self.drawn.pop, *reversed(node.children)]
            out.held.append(" ")
        elif tag in ("button", "select"):
            todo += [" ", *reversed(node.children)]
            out.held.append(" ")
        elif not node.block:
            todo += reversed(node.children)
        elif tag == "hr":
            out.gap()
            if node.visible:
                out.line("---")
            out.gap()
        elif tag in PREFORMATTED:
            out.gap()
            out.pre += 1
            todo += [self.end_preformatted, *reversed(node.children)]
        elif tag in LISTS:
            out.gap()
            todo.append(out.gap)
            self.items(node, todo)
        elif tag in ("blockquote", "dd"):
            if tag == "blockquote":
                out.gap()
                todo.append(out.gap)
            out.open(2)
            todo += [out.close, *reversed(node.children)]
        elif tag == "table":
            out.gap()
            todo.append(out.gap)
            self.table(node, todo)
        else:
            end = out.gap if tag in SPACED else out.flush
            end()
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo += [end, *reversed(children)]

    def end_preformatted(self) -> None:
        self.out.flush()
        self.out.pre -= 1
        self.out.gap()

    def items(self, node: Node, todo: list) -> None:
        ordered, step = node.tag == "ol", 1
        number = node.number("start", 10**9)
        if ordered and "reversed" in node.attrs:
            step = -1
            number = sum(isinstance(c, Node) and c.tag == "li" and c.shown for c in node.children) if number is None else number
        number = 1 if number is None else number
        ops: list = []
        for child in node.children:
            if isinstance(child, str) or child.tag != "li":
                if isinstance(child, Node) or child.strip(WHITE):
                    ops.append(child)
                continue
            if not child.shown:
                continue
            own = child.number("value", 10**9) if ordered else None
            number = number if own is None else own
            ops.append(_Item(self, child, f"{number}. " if ordered else "- "))
            number += step
        todo += reversed([x if isinstance(x, (str, Node)) else (lambda x=x: x.open(todo)) for x in ops])

    def table(self, node: Node, todo: list) -> None:
        rows, before = _parts(node)
        out = self.out
        ops: list = []
        for part in before:
            ops += [out.open, *part, out.close]
        if max(map(len, rows), default=0) < 2:
            for row in rows:
                for cell in row:
                    ops += [out.open, *cell.children, out.close]
        elif not out.align // 2:
            for row in rows:
                ops.append(out.flush)
                for k, cell in enumerate(row):
                    ops += [*([" | "] if k else []), *cell.children]
                ops.append(out.flush)
        else:
            grid = _placed(rows)
            bodies: list[list[list[str]]] = []
            for row in rows:
                bodies.append([])
                for cell in row:
                    ops += [self.begin_cell, *cell.children, lambda own=bodies[-1]: self.end_cell(own)]
            ops.append(lambda: self.lay_out(grid, bodies))
        todo += reversed(ops)

    def begin_cell(self) -> None:
        self.outer.append(self.out)
        self.out = _Out(self.out.align // 2)

    def end_cell(self, own: list[list[str]]) -> None:
        self.out.flush()
        own.append(_plain(self.out.lines))
        self.out = self.outer.pop()

    def lay_out(self, grid: list[list[int]], bodies: list[list[list[str]]]) -> None:
        """Write the rows: each cell at its column's offset, as the module's docstring says."""
        widths: dict[int, int] = {}
        for row, cells in zip(grid, bodies, strict=True):
            for column, lines in zip(row, cells, strict=True):
                widths[column] = max(widths.get(column, 0), max((len(x) for x in lines if len(x) <= CELL), default=0))
        offsets, at = {}, 0
        order = sorted(widths)
        for column in order:
            offsets[column] = min(at, self.out.align)
            at += widths[column] + 3
        self.out.flush()
        for row, cells in zip(grid, bodies, strict=True):
            open_ = list(zip(row, cells, strict=True))
            for k in range(max(map(len, cells), default=0)):
                line = ""
                if k:  # cells drop out as they end, so that a tall one doesn't cost its whole row for each line
                    open_ = [(c, x) for c, x in open_ if len(x) > k]
                for column, lines in open_:
                    text = lines[k] if len(lines) > k else ""
                    if k == 0 and column != row[0] or k and line.strip():
                        line = line.ljust(offsets[column] - 3) + " | " + text
                    else:
                        line = line.ljust(offsets[column]) + text
                if k == 0 and row[-1] != order[-1]:
                    line = line.ljust(offsets[order[bisect_right(order, row[-1])]] - 3) + " |"
                self.out.line(line.rstrip(WHITE))


class _Item:
    """A list item: its mark, and its children between the opening and the closing of a container."""

    def __init__(self, renderer: _Renderer, node: Node, mark: str):
        self.renderer, self.node, self.mark = renderer, node, mark

    def open(self, todo: list) -> None:
        out = self.renderer.out
        out.open(len(self.mark), self.mark if self.node.visible else None)
        todo += [lambda: out.close(mark=True), *reversed(self.node.children)]


def _parts(table: Node) -> tuple[list[list[Node]], list[list]]:
    """(rows of cells; captions and text that no cell holds, which come before the rows)."""
    rows, captions, loose = [], [], []
    todo, bare = list(reversed(table.children)), False
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip(WHITE):
                loose.append(child)
            continue
        if not child.shown or child.tag in ("colgroup", "col"):
            continue
        if child.tag in CELLS:  # a row without its tag
            if not bare:
                rows.append([])
            rows[-1].append(child)
            bare = True
            continue
        bare = False
        if child.tag in GROUPS:
            todo += reversed(child.children)
        elif child.tag == "tr":
            rows.append([c for c in child.children if isinstance(c, Node) and c.tag in CELLS and c.shown])
            loose += [c for c in child.children if (c.strip(WHITE) if isinstance(c, str) else c.tag not in CELLS)]
        elif child.tag == "caption":
            captions.append(child.children)
        else:
            loose.append(child)
    return rows, [*captions, *([loose] if loose else [])]


def _placed(rows: list[list[Node]]) -> list[list[int]]:
    """The column of each cell, by the column and row spans of those before.

    Columns that cells from above reach into are runs, each until a row of its own.  A row walks over the runs before its
    cells; where it has leapt from a column to the next free one, later rows leap at once while no run has ended.
    """
    starts, stops = [], []  # runs in order of columns: first, last + 1
    ending: dict[int, list[int]] = {}  # first columns of runs by the row where they end
    leaps: dict[int, int] = {}
    grid = []
    for r, row in enumerate(rows):
        for first in ending.pop(r, ()):
            k = bisect_left(starts, first)
            del starts[k], stops[k]
            leaps.clear()
        own, column, p = [], 0, 0
        fresh: list[tuple[int, int, int]] = []
        for cell in row:
            begin = column
            if begin in leaps:
                column = leaps[begin]
                p = bisect_right(starts, column)
                if p and stops[p - 1] > column:
                    column = stops[p - 1]
            while p < len(starts) and starts[p] <= column:
                column = max(column, stops[p])
                p += 1
            if column > begin:
                leaps[begin] = column
            wide = max(1, cell.number("colspan", 1000) or 1)
            high = cell.number("rowspan", 65534)
            high = len(rows) if high == 0 else max(1, high or 1)
            own.append(column)
            if high > 1:
                if fresh and fresh[-1][1:] == (column, r + high):
                    fresh[-1] = fresh[-1][0], column + wide, r + high
                else:
                    fresh.append((column, column + wide, r + high))
            column += wide
        for first, stop, end in fresh:  # no run begins at first: a cell is put where none is
            k = bisect_left(starts, first)
            if k < len(starts) and starts[k] < stop or k and stops[k - 1] > first:
                leaps.clear()  # runs that overlap
            starts.insert(k, first)
            stops.insert(k, stop)
            ending.setdefault(end, []).append(first)
        grid.append(own)
    return grid


def _plain(lines: list[str | None]) -> list[str]:
    """Lines with gaps as blank lines (a gap merges with blank lines next to it), without those at both ends."""
    out: list[str] = []
    blanks, gap = 0, False
    for x in lines:
        if x is None:
            gap = True
        elif not x:
            blanks += 1
        else:
            if out:
                out += [""] * max(blanks, int(gap))
            out.append(x)
            blanks, gap = 0, False
    return out


def text_of(html: str | None) -> str:
    """The rendered text of a page; empty for null, empty or invisible ones."""
    return "\n".join(_plain(_Renderer().run(parse(html)))) if html else ""


def extract(pages: DataFrame, html: str = "html", keep_html: bool = False) -> DataFrame:
    """pages with text, the rendered text of the whole page, in place of the html unless keep_html.

    Null, empty and invisible pages have an empty text. A column of pages called text is replaced, unless it is the html.
    """
    pages = with_columns_replaced(pages, [] if html.lower() == "text" else ["text"])
    at = pages.columns.index(html)
    stay = [k for k, c in enumerate(pages.columns) if keep_html or k != at]

    def run(batches):
        for batch in batches:
            offsets, _ = utf8_view(batch.column(at))
            for i, j in doc_slices(offsets, OUT_BYTES):
                part = batch.slice(i, j - i)
                texts = pa.array([text_of(h) for h in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in stay], texts], names=[*[part.schema.names[k] for k in stay], "text"])

    fields = [f"`{pages.columns[k]}` {pages.schema[k].dataType.simpleString()}" for k in stay]
    return pages.mapInArrow(run, ", ".join([*fields, "text string"]))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the rendered text of every page of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
