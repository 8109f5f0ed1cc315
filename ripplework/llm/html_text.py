"""HTML extraction by layout: a tree is built with the tags that authors leave out, and rendered as a browser shows it.

Parsing. Comments, doctypes and processing instructions are skipped. Script, style, textarea and title are raw
up to their end tag. Start tags close what they imply (a paragraph before a block, a list item before the next,
cells and rows of a table, options, terms). End tags close up to their element, within a table cell at most up
to the cell; an end tag without a start is ignored. What is open at the end is closed there; a tag that
the page's end cuts off is text, a comment isn't; a quoted value without its end ends with its tag, at the next ">".
Each tag costs a constant time, however many elements are open, so that long broken pages take time in proportion to
their length.

Visibility. Head, script, style, template and other elements that show no text, elements with the hidden
attribute, aria-hidden="true" or a style of display:none or visibility:hidden, and hidden inputs are left out.
Images show their alt text.

Rendering. White space collapses, but not in pre and textarea. Blocks stand on lines of their own; paragraphs,
headings, lists, tables and the like have a blank line around them, margins collapsing. List items have "- " or
their number, nested lists are indented, by at most INDENT columns. Table cells are aligned in columns separated by
two blanks; a cell's own lines are joined by a blank, colspan counts; cells of more than WIDE characters don't widen
their column, and at most WIDE blanks align a cell. Cells within another element are cells of the row, and what else
stands in a table, outside of its cells, is shown before it. Tables within tables, however deep, are laid out from
the innermost on. Formulas, and texts of drawings, are text. Links and other inline elements leave their text in its
line.

Null html is an empty page. Attributes without values, unknown elements and broken markup don't stop it. Rows
are handled each by itself; null ids stay null; further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm import common

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
UNSEEN = frozenset("head script style template noscript title meta link base datalist object embed audio video canvas iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote table figure fieldset hr".split())
LISTS = frozenset("ul ol menu dir".split())
#: What a drawing or a formula doesn't show.
UNDRAWN = {"svg": frozenset("defs symbol clippath mask pattern marker metadata desc".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
#: What a start tag closes, and up to which open element it looks.
CLOSES = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"caption", "colgroup", "tbody"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: End tags of elements inside these don't reach beyond them.
WALLS = frozenset("td th caption table".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The next attribute of a tag: its name and value, quoted (then the closing quote, if there is one) or not.
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"?)|'([^']*+)('?)|([^\s>\"'][^\s>]*+)?))?+")
TAG_END = re.compile(r"[\s/]*+>")
#: Columns that lists indent a line by at most; characters of a table's cell that its column is as wide as.
INDENT, WIDE = 80, 100
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
SPACE = re.compile(r"[ \t\n\f\r]+")
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.IGNORECASE) for name in RAW}
HEAD_ONLY = frozenset("title meta link base style script template noscript".split())


#: For each element name, the entries of CLOSES that it bounds, and those that it is closed by.
BOUNDS = {x: [k for k, (_, upto) in CLOSES.items() if x in upto] for x in set().union(*(u for _, u in CLOSES.values()))}
CLOSED = {x: [k for k, (names, _) in CLOSES.items() if x in names] for x in set().union(*(n for n, _ in CLOSES.values()))}
#: End tags that reach beyond walls.
FAR = frozenset("table tr tbody thead tfoot".split())


class Node:
    __slots__ = ("attributes", "children", "closes", "inside", "laid", "name", "paragraph")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []
        self.inside = ""  # svg, text (of a drawing) or math
        self.laid = ""  # a table's text
        self.paragraph = 0  # while open: the depth of the paragraph that a block would end, 0 if none
        self.closes: dict[str, int] = {}  # while open: what a start tag would close, as the least depth


class Open:
    """The open elements, with what is needed to find the one that a tag closes at once."""

    def __init__(self, root: Node):
        self.nodes, self.all, self.scopes = [root], Counter(), [Counter()]

    def push(self, node: Node) -> None:
        top, depth, name = self.nodes[-1], len(self.nodes), node.name
        node.paragraph = depth if name == "p" else 0 if name in BLOCK or name in WALLS else top.paragraph
        node.closes = top.closes
        if name in BOUNDS or name in CLOSED:
            node.closes = {k: d for k, d in top.closes.items() if k not in BOUNDS.get(name, ())}
            for k in CLOSED.get(name, ()):
                if k not in BOUNDS.get(name, ()):
                    node.closes.setdefault(k, depth)
        self.nodes.append(node)
        self.all[name] += 1
        self.scopes[-1][name] += 1
        if name in WALLS:
            self.scopes.append(Counter())

    def pop_to(self, depth: int) -> None:
        while len(self.nodes) > depth:
            name = self.nodes.pop().name
            if name in WALLS:
                self.scopes.pop()
            self.all[name] -= 1
            self.scopes[-1][name] -= 1

    def end(self, name: str) -> None:
        """Close the last open element of the name that an end tag reaches."""
        own = name in WALLS and len(self.scopes) > 1 and self.scopes[-2][name]  # perhaps the wall itself
        if self.all[name] if name in FAR else self.scopes[-1][name] or own:
            for depth in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[depth].name == name:
                    self.pop_to(depth)
                    return
                if self.nodes[depth].name in WALLS and name not in FAR:
                    return


def parse(source: str) -> Node:
    root = Node("#root", {})
    open_ = Open(root)
    nodes = open_.nodes
    at, size = 0, len(source)
    while at < size:
        begin = at
        while True:  # up to what is no text
            begin = source.find("<", begin)
            if begin < 0 or source[begin + 1 : begin + 2] in ("!", "?") or NAME.match(source, begin + 1):
                break
            if source[begin + 1 : begin + 2] == "/" and begin + 2 < size:
                break
            begin += 1
        value = source[at : begin if begin >= 0 else size]
        if value:
            if nodes[-1].name == "head" and value.strip():
                open_.pop_to(len(nodes) - 1)
            nodes[-1].children.append(html.unescape(value))
        if begin < 0:
            break
        ending = source[begin + 1] == "/"
        m = NAME.match(source, begin + 1 + ending)
        if not m:  # a comment, or what counts as one
            comment = source.startswith("<!--", begin)
            stop = source.find("-->" if comment else ">", begin + 2)
            at = size if stop < 0 else stop + (3 if comment else 1)
            continue
        at, name, attributes = m.end(), m[0].lower(), {}
        while not (stop := TAG_END.match(source, at)):
            a = ATTRIBUTE.match(source, at)
            if not a or (a[2] is not None and not a[3]) or (a[4] is not None and not a[5]):
                break
            attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[4] or a[6] or ""))
            at = a.end()
        closed, end = (stop[0][-2:] == "/>", stop.end()) if stop else (False, source.find(">", m.end()) + 1)
        if not end:
            nodes[-1].children.append(html.unescape(source[begin:]))
            break
        at = end
        if ending:
            open_.end(name)
            continue
        if nodes[-1].name == "head" and name not in HEAD_ONLY:
            open_.pop_to(len(nodes) - 1)
        if name in BLOCK and nodes[-1].paragraph:  # a block ends an open paragraph
            open_.pop_to(nodes[-1].paragraph)
        if name in CLOSES and name in nodes[-1].closes:
            open_.pop_to(nodes[-1].closes[name])
        node = Node(name, attributes)
        top = nodes[-1]
        node.inside = name if name in UNDRAWN else "" if name == "foreignobject" else "text" if name == "text" and top.inside == "svg" else top.inside
        if name in UNDRAWN.get(node.inside, ()):
            attributes["hidden"] = ""
        top.children.append(node)
        if name in RAW:
            end = RAW_END[name].search(source, at)
            content = source[at : end.start() if end else size]
            node.children.append(html.unescape(content) if name in ("textarea", "title") else content)
            at = end.end() if end else size
        elif name not in VOID and not (closed and (node.inside or name == "path")):  # a slash means nothing on an HTML element
            open_.push(node)
    return root


def visible(node: Node) -> bool:
    a = node.attributes
    return not (node.name in UNSEEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(a.get("style", "")) or (node.name == "input" and a.get("type", "").lower() in ("hidden", "password")))


class Page:
    """Lines of text; `gap` says what the next text is preceded by: 0 nothing, 1 a line break, 2 a blank line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is being written
        self.gap, self.space = 0, False
        self.prefix, self.indent = "", ""

    def _close(self) -> str:
        line, self.parts, self.space = "".join(self.parts).rstrip(), [], False
        return line

    def brk(self, gap: int) -> None:
        if line := self._close():
            self.lines.append(line)
            self.gap = 0
        self.gap = max(self.gap, gap)

    def start(self) -> None:
        if not self.parts:
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.parts = [self.indent[: len(self.indent) - len(self.prefix)], self.prefix]
            self.prefix, self.space = "", False

    def put(self, text: str) -> None:
        for i, word in enumerate(SPACE.split(text)):
            if i:
                self.space = True
            if word:
                fresh = not self.parts
                self.start()
                if self.space and not fresh:
                    self.parts.append(" ")
                self.parts.append(word)
                self.space = False

    def put_raw(self, text: str) -> None:
        for i, part in enumerate(text.split("\n")):
            if i:
                self.start()
                self.lines.append(self._close())
            if part:
                self.start()
                self.parts.append(part)

    def newline(self) -> None:
        if self.parts:
            self.lines.append(self._close())
        elif self.lines and self.lines[-1]:
            self.gap = max(self.gap, 1)
        self.space = False

    def text(self) -> str:
        self.brk(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _rows(table: Node) -> tuple[list[list[tuple[str, int]]], list[Node | str]]:
    """Rows of (text, columns), in order, of a table's own rows, and what stands in it but in no caption or cell."""
    rows: list[list[tuple[str, int]]] = []
    loose: list[Node | str] = []
    row: list[tuple[str, int]] | None = None
    holders = _holders(table)
    stack = [iter(table.children)]
    in_row: list[bool] = [False]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if in_row.pop():
                row = None
            continue
        if isinstance(child, str):
            if child.strip():
                loose.append(child)
            continue
        if not visible(child) or child.name == "col" or (child.name == "caption" and len(stack) == 1):
            continue
        if child.name in ("td", "th"):
            if row is None or len(stack) == 1:
                row = []
                rows.append(row)
            span = child.attributes.get("colspan", "1")
            row.append((" ".join(x.strip() for x in render(child).split("\n") if x.strip()), min(int(span), 1000) if span.isdigit() and int(span) else 1))
        elif child.name == "tr":
            row = []
            rows.append(row)
            stack.append(iter(child.children))
            in_row.append(True)
        elif child.name in ("tbody", "thead", "tfoot") or id(child) in holders:
            stack.append(iter(child.children))
            in_row.append(False)
        else:
            loose.append(child)
    return [r for r in rows if r], loose


def _holders(table: Node) -> set[int]:
    """ids of the elements in which rows or cells of this table stand."""
    out: set[int] = set()
    above: dict[int, Node] = {}
    todo = [table]
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, str):
                continue
            above[id(c)] = node
            if c.name in ("tr", "td", "th"):
                up = node
                while up is not table and id(up) not in out:
                    out.add(id(up))
                    up = above[id(up)]
            if c.name not in ("table", "td", "th", "caption"):
                todo.append(c)
    return out


def _lay(table: Node) -> str:
    """A table's text; the tables within it have theirs already."""
    page = Page()
    for c in table.children:
        if not isinstance(c, str) and c.name == "caption" and visible(c):
            page.put(render(c).replace("\n", " "))
            page.brk(1)
    rows, loose = _rows(table)
    for c in loose:  # what doesn't belong into a table is shown before it
        holder = Node("div", {})
        holder.children = [c]
        page.put(render(holder).replace("\n", " "))
        page.brk(1)
    columns = sorted({k for row in rows for k, _ in _placed(row)})
    number = {k: i for i, k in enumerate(columns)}
    widths = [0] * len(columns)
    for row in rows:
        for (k, text), (_, span) in zip(_placed(row), row, strict=True):
            if number[k] + 1 == len(columns) or columns[number[k] + 1] >= k + span:
                widths[number[k]] = max(widths[number[k]], len(text) if len(text) <= WIDE else 0)
    edges = list(accumulate(widths, lambda a, w: a + w + 2, initial=0))
    for row in rows:
        parts, length, shift = [], 0, 0
        for k, text in _placed(row):
            if text:
                edge = edges[number[k]] + shift
                shift += max(0, length + 2 * bool(length) - edge)
                pad = min(max(edge - length, 2 * bool(length)), WIDE)
                parts += [" " * pad, text]
                length += pad + len(text)
        if line := "".join(parts).rstrip():
            page.brk(1)
            page.start()
            page.parts.append(line)
            page.brk(1)
    return page.text()


def _placed(row: list[tuple[str, int]]) -> Iterator[tuple[int, str]]:
    """The column where each cell begins, and its text."""
    k = 0
    for text, span in row:
        yield k, text
        k += span


def _tables(root: Node) -> list[Node]:
    """All tables, outer ones before those within them."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.name == "table":
            out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def render(node: Node) -> str:
    """The visible text of a tree, whose tables are laid out already. Without recursion."""
    page = Page()
    lists: list[list] = []  # name, next number, indent before it
    stack: list = [("open", node, False)]
    while stack:
        step, node, raw = stack.pop()
        if step == "text":
            if raw:
                page.put_raw(node)
            else:
                page.put(node)
            continue
        name = node.name
        if step == "close":
            page.brk(2 if name in SPACED and not (name in LISTS and lists[:-1]) else 1) if name in BLOCK else None
            if name in LISTS and lists:
                page.indent = lists.pop()[2]
            elif name in ("li", "dd", "blockquote"):
                page.indent, page.prefix = page.indent[: -node.attributes["#indent"]] if node.attributes["#indent"] else page.indent, ""
            continue
        if name != "#root" and not visible(node):
            continue
        if name == "br":
            page.newline()
            continue
        if name == "wbr":
            continue
        if name == "img":
            page.put(node.attributes.get("alt", ""))
            continue
        if name == "input":
            page.put(node.attributes.get("value", "") if node.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text") else "")
            continue
        if name in BLOCK:
            page.brk(2 if name in SPACED and not (name in LISTS and lists) else 1)
        if name == "hr":
            page.brk(2)
            continue
        if name == "table":
            for line in node.laid.split("\n"):
                if line:
                    page.brk(1)
                    page.start()
                    page.parts.append(line)
            page.brk(2)
            continue
        if name in LISTS:
            number = node.attributes.get("start", "1")
            lists.append([name, int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1, page.indent])
        elif name == "li":
            mark = "- "
            if lists and lists[-1][0] == "ol":
                value = node.attributes.get("value", "")
                lists[-1][1] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else lists[-1][1]
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            page.prefix = mark
            node.attributes["#indent"] = len(mark) if len(page.indent) < INDENT else 0
            page.indent += " " * node.attributes["#indent"]
        elif name in ("dd", "blockquote"):
            node.attributes["#indent"] = 2 if len(page.indent) < INDENT else 0
            page.indent += " " * node.attributes["#indent"]
        raw = raw or name in ("pre", "textarea")
        stack.append(("close", node, raw))
        for child in reversed(node.children):
            if not (isinstance(child, str) and node.inside == "svg"):
                stack.append(("text", child, raw) if isinstance(child, str) else ("open", child, raw))
        if name in ("td", "th", "option") or (name == "text" and node.inside == "text"):
            page.put(" ")
    return page.text()


def page_text(source: str | None) -> str:
    root = parse(source or "")
    for table in reversed(_tables(root)):
        table.laid = _lay(table)
    return render(root)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        yield pa.RecordBatch.from_arrays([got.column(0), pa.array([page_text(x) for x in got.column(1).to_pylist()], pa.string())], ["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id and text, the page as shown, of pages (page_id, html). Nothing is shuffled."""
    common.bound_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(_extract, "page_id long, text string").select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))
