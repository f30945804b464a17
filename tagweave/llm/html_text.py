"""op6: visible text of HTML by layout-aware rendering.

A tree builder applies the rules by which tags imply others (a paragraph ends where a block begins, a list item where
the next begins, cells and rows likewise) and by which elements are hidden (elements that are never shown, the hidden
attribute, closed details, inline styles and style sheets' rules that hold on every screen, by the cascade of
tagweave/llm/styles.py). A renderer walks the tree and emits all that is visible: blocks on lines of their own, with a blank line around
those that have margins, lists with their marks and indents, and tables with aligned cells, captions above them. No part
of a page is judged to be boilerplate and dropped.

Nothing here recurses: nesting of any depth is walked with a stack. What layout adds is bounded by constants for each
line and cell (INDENT, COLUMN, LINE, NESTED), so that time and output grow in proportion to the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tagweave.llm.common import map_rows, own_names, table
from tagweave.llm.markup import Markup
from tagweave.llm.styles import Styles, on_screens, rules

#: Elements by how they are shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style template noscript iframe object audio video canvas datalist title meta link base".split())
#: Of drawings and formulas, what is not drawn where it stands.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask marker pattern annotation annotation-xml".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCK = MARGIN | frozenset("address article aside body center dd details dialog div dt fieldset figcaption footer form header hgroup html legend li main menu nav search section summary tr caption thead tbody tfoot".split())
#: A start tag ends these open elements, up to the nearest of the second set.
LIST = frozenset(("ul", "ol", "menu", "dl"))
CELLS, ROWS = frozenset(("td", "th")), frozenset(("tr",))
PARTS = frozenset(("thead", "tbody", "tfoot", "caption", "colgroup"))
TABLE = frozenset(("table",))
IMPLIED = {
    "li": (frozenset(("li",)), LIST), "dt": (frozenset(("dt", "dd")), LIST), "dd": (frozenset(("dt", "dd")), LIST),
    "td": (CELLS, TABLE | ROWS), "th": (CELLS, TABLE | ROWS), "tr": (ROWS | frozenset(("caption", "colgroup")), TABLE),
    "thead": (PARTS, TABLE), "tbody": (PARTS, TABLE), "tfoot": (PARTS, TABLE), "option": (frozenset(("option",)), frozenset(("select",))),
}
#: Blocks before which an open paragraph ends; a paragraph inside one of the stops stays as it is.
ENDS_P = BLOCK - frozenset(("html", "body", "tr", "thead", "tbody", "tfoot", "caption"))
P_STOPS = frozenset(("td", "th", "caption", "button", "body", "html", "table", "object"))
#: Inputs whose value isn't text on the page.
WORDLESS = frozenset("hidden password checkbox radio file range color image".split())
#: Largest indent; widest column that others are aligned to; where a line of cells ends; tables in tables that are laid
#: out; columns that a cell takes at most, and that cells of rows above can take.
INDENT, COLUMN, LINE, NESTED, COLUMNS = 40, 80, 400, 8, 100


class Node:
    """An element or (tag None) a run of text."""

    __slots__ = ("attrs", "children", "drawn", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = "") -> None:
        self.tag, self.attrs, self.text, self.children, self.drawn = tag, attrs or {}, text, [], True


class Builder(Markup):
    """Builds the tree and reads the style sheets."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # where elements of a tag are open
        self.styles = Styles()

    def _pop(self) -> None:
        self.at[self.open.pop().tag].pop()

    def _close(self, tags: frozenset[str], stops: frozenset[str]) -> None:
        """Ends the innermost open element of `tags`, and all inside it, if no stop is nearer."""
        k = max((self.at[t][-1] for t in tags if self.at[t]), default=0)
        if k and k >= max((self.at[t][-1] for t in stops if self.at[t]), default=0):
            while len(self.open) > k:
                self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            self.open[0].attrs.update({k: v or "" for k, v in attrs if k not in ("hidden", "style")})
            self._close(frozenset(("head",)), frozenset())
            return
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
            if tag in PARTS:
                self._close(PARTS, TABLE)
        if tag in ENDS_P:
            self._close(frozenset(("p",)), P_STOPS)
        if self.open[-1].tag == "head" and tag not in NEVER:
            self._pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        if self.at["svg"] or self.at["math"]:
            node.drawn = tag not in UNDRAWN
            if node.attrs.get("display") == "none":
                node.attrs["hidden"] = ""
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.at[tag].append(len(self.open))
            self.open.append(node)

    def handle_empty(self, tag: str) -> bool:
        """In drawings and formulas a slash ends an element; elsewhere it means nothing."""
        if not (self.at["svg"] or self.at["math"]) or self.open[-1].tag != tag:
            return False
        self._pop()
        return True

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag not in VOID:
            stops = TABLE if tag not in TABLE else frozenset()
            self._close(frozenset((tag,)), stops | (CELLS if tag not in CELLS | ROWS | PARTS | TABLE else frozenset()))

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag == "style":
            for selector, says in rules(data) if on_screens(top.attrs.get("media", "")) else ():
                self.styles.add(selector, says)
            return
        if top.tag in ("pre", "textarea") and not top.children:  # a line end right after the tag doesn't count
            data = data.removeprefix("\r").removeprefix("\n")
        top.children.append(Node(None, text=data))


class Writer:
    """Lines of text: collapses white space and keeps blocks, blank lines and indents apart."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.blank = False
        self.mark: list[tuple[str, int]] = []  # marks that wait for text, with their indents
        self.indent = 0

    def text(self, s: str, keep: bool = False) -> None:
        if keep:
            first, *rest = s.split("\n")
            self._put(first)
            for line in rest:
                self.newline(True)
                self._put(line)
            return
        words = s.split()
        if not words:
            self.space |= bool(s) and bool(self.now)
            return
        if (self.space or s[0].isspace()) and self.now:
            self.now.append(" ")
        self._put(" ".join(words))
        self.space = s[-1].isspace()

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.now:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            marks = "".join(m for m, _ in self.mark)
            self.now.append(" " * min(INDENT, self.mark[0][1]) + marks if marks else " " * min(INDENT, self.indent))
            self.mark.clear()
        self.now.append(s)

    def newline(self, force: bool = False) -> None:
        if self.now or force:
            self.lines.append("".join(self.now).rstrip())
        self.now.clear()
        self.space = False

    def margin(self) -> None:
        self.newline()
        self.blank = True

    def done(self) -> list[str]:
        self.newline()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Cell(NamedTuple):
    """Lines of a cell, and the columns and rows that it takes."""

    lines: list[str]
    columns: int
    rows: int


def placed(rows: list[list[Cell]]) -> list[list[tuple[int, Cell]]]:
    """Each row's cells with their first columns: the first COLUMNS that cells of rows above still take are passed over."""
    out, taken = [], {}  # taken: of a column, the first row that is free again
    for r, row in enumerate(rows):
        at, line = 0, []
        for cell in row:
            while at < COLUMNS and taken.get(at, 0) > r:
                at += 1
            line.append((at, cell))
            if cell.rows > 1 and at < COLUMNS:
                taken.update((c, r + cell.rows) for c in range(at, at + cell.columns))
            at += cell.columns
        out.append(line)
    return out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Lines of a table: columns padded to their widest cell, or to COLUMN.

    What stands after a cell beyond its room, or further than LINE from the left, begins a line of its own.
    """
    table_ = placed(rows)
    width: dict[int, int] = {}
    wide = []
    for row in table_:
        for at, cell in row:
            longest = max(map(len, cell.lines), default=0)
            for c in range(at, at + cell.columns):
                width.setdefault(c, 0)
            if cell.columns == 1:
                width[at] = max(width[at], min(COLUMN, longest))
            else:
                wide.append((at, cell.columns, min(COLUMN, longest)))
    for at, n, longest in wide:  # what a cell over several columns needs beyond them goes to its last
        lack = longest - sum(width[c] for c in range(at, at + n)) - 2 * (n - 1)
        width[at + n - 1] += max(0, lack)
    start, end = {}, 0
    for c in range(max(width, default=-1) + 1):
        start[c] = end
        end += width.get(c, 0) + 2
    out = []
    for row in table_:
        some, k = [x for x in row if x[1].lines], 0
        while some:
            line = ""
            for at, cell in some:
                if cell.lines[k]:
                    if line and (len(line) + 2 > start[at] or start[at] > LINE):
                        out.append(line)
                        line = ""
                    line = line.ljust(start[at] if start[at] <= LINE else 2) + cell.lines[k]
            out.append(line.rstrip())
            k += 1
            some = [x for x in some if len(x[1].lines) > k]
    return out


class _Table:
    """What of a table has been read: captions, rows, and whether a row is open."""

    def __init__(self) -> None:
        self.captions: list[str] = []
        self.rows: list[list[Cell]] = []
        self.open = False

    def row(self) -> None:
        self.rows.append([])
        self.open = True


def _number(value: str, least: int, most: int, instead: int) -> int:
    return min(most, max(least, int(value))) if re.fullmatch(r"-?\d{1,9}", value.strip()) else instead


def there(node: Node, gone: bool | None) -> bool:
    """Whether an element is in the page; gone: what its styles say of it, which the hidden attribute is weaker than."""
    if node.tag == "html":
        return True
    if node.tag in NEVER or not node.drawn or (node.tag in ("input", "textarea") and node.attrs.get("type") == "hidden"):
        return False
    if gone is None:
        return "hidden" not in node.attrs and (node.tag != "dialog" or "open" in node.attrs)
    return not gone


def rendered(page: str) -> str:
    """The visible text of a page."""
    b = Builder()
    b.feed(page)
    styles = b.styles
    writers = [Writer()]
    tables: list[_Table] = []
    lists: list[list] = []  # [ordered, next number, step]
    marks: list[int] = []  # widths of the marks of open list items
    keep = nested = 0
    stack: list[tuple[Node, bool, bool]] = [(b.root, False, True)]
    while stack:
        node, leaving, visible = stack.pop()
        w, tag = writers[-1], node.tag
        laid = bool(tables) and nested == len(tables)  # whether cells here are those of a table that is laid out
        if tag is None:
            if visible:
                w.text(node.text, keep > 0)
            continue
        if not leaving:
            told, steps = styles.told(tag, node.attrs)
            if not there(node, told.get("display")):
                continue
            own = told.get("visibility")
            visible = visible if own is None else own
            if tag == "br":
                w.newline(True) if w.now or w.lines else None
                continue
            if tag == "img" or (tag == "input" and node.attrs.get("type", "").lower() == "image"):
                if visible and node.attrs.get("alt", "").strip():
                    w.text(f" {node.attrs['alt']} ")
                continue
            if tag == "input":
                if visible and node.attrs.get("type", "text").lower() not in WORDLESS and node.attrs.get("value"):
                    w.text(f" {node.attrs['value']} ")
                continue
            inside = bool(lists) and tag in LIST
            if tag in MARGIN and not inside:
                w.margin()
            elif tag in BLOCK or tag == "option":
                w.newline()
            elif tag == "text":  # a drawing's texts stand apart
                w.text(" ")
            if tag == "hr":
                continue
            if tag in ("td", "th"):
                if laid:
                    if not tables[-1].open:
                        tables[-1].row()
                    writers.append(Writer())
                else:
                    w.text(" ")
            elif tag == "tr" and laid:
                tables[-1].row()
            elif tag == "table":
                nested += 1
                if nested <= NESTED:
                    tables.append(_Table())
            elif tag == "caption" and laid:
                writers.append(Writer())
            elif tag in ("ul", "ol", "menu"):
                step = -1 if tag == "ol" and "reversed" in node.attrs else 1
                first = sum(c.tag == "li" for c in node.children) if step < 0 else 1
                lists.append([tag == "ol", _number(node.attrs.get("start", ""), -(10**9), 10**9, first), step])
                w.indent += 2 if len(lists) > 1 else 0
            elif tag == "li":
                level = lists[-1] if lists else [False, 1, 1]
                level[1] = _number(node.attrs.get("value", ""), -(10**9), 10**9, level[1])
                mark = f"{level[1]}. " if level[0] else "- "
                level[1] += level[2]
                if visible:
                    w.mark.append((mark, w.indent))
                marks.append(len(mark))
                w.indent += len(mark)
            elif tag in ("dd", "blockquote"):
                w.indent += 2
            elif tag in ("pre", "textarea"):
                keep += 1
            elif tag == "q" and visible:
                w.text('"', True)
            stack.append((node, True, visible))
            styles.enter(steps)
            children = node.children
            if tag == "details" and "open" not in node.attrs:  # closed: its first summary alone is there
                children = [c for c in children if c.tag == "summary"][:1]
            stack.extend((c, False, visible) for c in reversed(children))
            continue
        styles.leave()
        if tag in ("td", "th") and laid:
            size = [_number(node.attrs.get(k, ""), 1, most, 1) for k, most in (("colspan", COLUMNS), ("rowspan", 10 * COLUMNS))]
            tables[-1].rows[-1].append(Cell(writers.pop().done(), *size))
            continue
        if tag == "caption" and laid:
            tables[-1].captions += writers.pop().done()
            continue
        if tag == "tr" and laid:
            tables[-1].open = False
        elif tag == "table":
            nested -= 1
            if nested < NESTED:
                t = tables.pop()
                for line in t.captions + aligned([r for r in t.rows if r]):
                    w.newline()
                    w.text(line, True)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
            w.indent -= 2 if lists else 0
        elif tag == "li":
            w.newline()
            w.indent -= marks.pop()
            w.mark.clear()
        elif tag in ("dd", "blockquote"):
            w.newline()
            w.indent -= 2
        elif tag in ("pre", "textarea"):
            keep -= 1
        elif tag == "q" and visible:
            w.text('"', True)
        if tag in MARGIN and not (bool(lists) and tag in LIST):
            w.margin()
        elif tag in BLOCK or tag == "option":
            w.newline()
        elif tag == "text":
            w.text(" ")
    return "\n".join(writers[0].done())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, `keep`, text, n_chars (of the text), n_lines for every page.

    A null or empty page has the text "", 0 characters and 0 lines. Broken markup is read as far as the rules above go:
    text is never lost to a tag that isn't closed, but inside elements that are never shown. Pages of any length are read
    whole, in time and with output in proportion to it. Repeated rows give repeated results, an empty table none; other
    columns are ignored. Kept columns that are called like a result get an underscore at the end of their names.
    """
    types = dict(pages.dtypes)
    keep = tuple(c for c in keep if c not in (id_col, html_col))
    names = own_names(keep, (id_col, "text", "n_chars", "n_lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [rendered(p or "") for p in b.column(1).to_pylist()]
            counts = [pa.array(map(len, text), pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in text], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(text, pa.string()), *counts], [id_col, *names, "text", "n_chars", "n_lines"])

    ddl = f"`{id_col}` {types[id_col]}" + "".join(f", `{n}` {types[c]}" for n, c in zip(names, keep, strict=True)) + ", text string, n_chars long, n_lines long"
    return map_rows(pages.select(id_col, html_col, *keep), run, ddl)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of all pages."""
    return extract(table(spark, sf_dir, "pages"), keep=("url",))
