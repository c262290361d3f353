"""HTML extraction by layout-aware rendering.

A tokenizer and a tree builder with implied tags (a paragraph ends where a block begins; list items, table rows and
cells, options and definitions end where the next begins; an end tag closes what is open inside it) make a tree. The
renderer walks it and emits all visible text. Not shown are elements that browsers do not show (head, script, style,
template, closed dialogs and the like), those with the attribute hidden or with display:none, and closed details but for
their summary; visibility is inherited, so that a visible child of a hidden element is shown. Text of MathML and SVG is
shown, without their annotations and definitions. Blocks stand on lines of their own, paragraphs, headings, lists and
tables between blank lines; list items carry their mark and are indented by depth; cells of a table's column are aligned,
with cells that span columns or rows in their places; white space is collapsed but in pre, xmp and textarea.

Layout has bounds, so that output and time stay in proportion to the page; none of them drops text. A line is indented by
MOST_INDENT columns at most, and no gap between cells is wider. Lines of a cell longer than WIDEST do not widen their
column; they push what follows on their line. Columns beyond the MOST_COLUMNS-th are one. Tables of one column are set as
blocks, as are tables inside DEEPEST tables of several columns.

Scale: one pass over the pages in Arrow batches, no shuffle; a task holds one page's tree at a time, some 200 bytes an
element, so a page of many MB is held by one task. Open elements are found by name, not by walking the stack, so the time
is in proportion to the page whatever its nesting; only tables of several columns recurse, DEEPEST deep.

Edge cases: null and empty pages give an empty text; broken markup always gives some tree; repeated rows each give a row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, slices

#: Comments and declarations; tags, whose quotes count only after an equals sign; text.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)>?|([^<]++|<)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"']\S*)))?""")
#: Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noembed noframes iframe object embed canvas audio video datalist meta link base param source track progress meter rp annotation annotation-xml desc defs metadata symbol clippath mask pattern marker".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption colgroup noscript xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre listing xmp figure hr".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption colgroup option optgroup legend summary noscript".split())
EXACT = frozenset({"pre", "listing", "xmp", "textarea"})
LISTS = frozenset({"ul", "ol", "menu", "dir"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
SECTIONS = frozenset({"tbody", "thead", "tfoot"})
#: An end tag does not reach beyond these; a paragraph does not either beyond a button.
SCOPE = ("table", "td", "th", "caption", "html", "template", "object", "marquee", "applet")
_PARTS = ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup")
#: An element that opens ends those open ones, up to a boundary.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir", *SCOPE)), "dt": (("dt", "dd"), ("dl", *SCOPE)), "dd": (("dt", "dd"), ("dl", *SCOPE)),
    "option": (("option",), ("select", "datalist", *SCOPE)), "optgroup": (("option", "optgroup"), ("select", *SCOPE)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "caption": (_PARTS, ("table",)),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (_PARTS, ("table",))),
}
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")
#: Input fields that show their value.
SHOWN_INPUTS = frozenset(("", "text", "search", "email", "url", "tel", "number", "submit", "button", "reset"))
MOST_INDENT, WIDEST, DEEPEST = 200, 100, 12
#: What the HTML standard lets a cell span.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
_NONE: dict[str, str] = {}


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str] = _NONE):
        self.name, self.attributes, self.children = name, attributes, []


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(text)))} if text.strip(" \t\n\r\f/") else _NONE


class Open:
    """The open elements, and where each name stands among them."""

    def __init__(self) -> None:
        self.nodes, self.at = [Node("#root")], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Close all from the k-th on."""
        while len(self.nodes) > k:
            self.at[self.nodes.pop().name].pop()

    def last(self, *names: str) -> int:
        """Where the innermost of these stands, or 0."""
        return max((a[-1] for n in names if (a := self.at.get(n))), default=0)

    def first_after(self, k: int, names: tuple[str, ...]) -> int:
        """Where the outermost of these inside the k-th stands, or 0."""
        return min((a[i] for n in names if (a := self.at.get(n)) and (i := bisect_right(a, k)) < len(a)), default=0)

    def add(self, child: Node | str) -> None:
        self.nodes[-1].children.append(child)


def parse(page: str) -> Node:
    """The tree of a page, whatever the page."""
    stack, at, n = Open(), 0, len(page)
    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            stack.add(html.unescape(m[4]) if "&" in m[4] else m[4])
            continue
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            _close(stack, name)
            continue
        _imply(stack, name)
        node = Node(name, attributes(m[3]) if m[3] else _NONE)
        stack.add(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
            at = end.end() if end else n
        elif name not in VOID and not (m[3].endswith("/") and stack.last("svg", "math")):
            stack.push(node)
    return stack.nodes[0]


def _imply(stack: Open, name: str) -> None:
    """Close what an opening tag ends, and open what it implies."""
    if name in CLOSES_P and (p := stack.last("p")) > stack.last("button", *SCOPE):
        stack.cut(p)
    if name in ENDS:
        ends, edge = ENDS[name]
        if k := stack.first_after(stack.last(*edge), ends):
            stack.cut(k)
    if name in HEADINGS and stack.nodes[-1].name in HEADINGS:
        stack.cut(len(stack.nodes) - 1)
    if name == "body" and stack.last("head"):
        _close(stack, "head")
    if name in ("td", "th") and (stack.nodes[-1].name == "table" or stack.nodes[-1].name in SECTIONS):
        row = Node("tr")
        stack.add(row)
        stack.push(row)
    if stack.nodes[-1].name == "head" and name not in UNSEEN and name not in ("html", "noscript"):
        stack.cut(len(stack.nodes) - 1)


def _close(stack: Open, name: str) -> None:
    edge = () if name in ("table", "body", "html") else ("table",) if name in _PARTS else [x for x in SCOPE if x != name]
    if (k := stack.last(name)) > stack.last(*edge):
        stack.cut(k)
    elif name in ("p", "br"):
        stack.add(Node(name))


def displayed(node: Node) -> bool:
    a = node.attributes
    if node.name in UNSEEN or (node.name == "dialog" and "open" not in a):
        return False
    return not a or not ("hidden" in a or ("style" in a and NO_DISPLAY.search(a["style"])) or (node.name == "input" and a.get("type", "").lower() == "hidden"))


def shown(node: Node, inherited: bool) -> bool:
    """Whether the text in a displayed element is visible."""
    said = VISIBILITY.findall(node.attributes["style"]) if "style" in node.attributes else ()
    return said[-1].lower() == "visible" if said else inherited


class Page:
    """Lines under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of what is not ended yet, none of them empty
        self.blank, self.mark, self.indent = False, "", 0

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if not self.parts or self.parts[-1][-1] in " \n":
            s = s.lstrip(" ")
        self.exact(s)

    def exact(self, s: str) -> None:
        if s:
            self.parts.append(s)

    def line_break(self) -> None:
        while self.parts:
            if last := self.parts.pop().rstrip(" "):
                self.parts += last, "\n"
                break

    def end_line(self) -> None:
        text = "".join(self.parts).rstrip(" ")
        self.parts = []
        if text.endswith("\n"):  # a break at the end of a block shows nothing
            text = text[:-1].rstrip(" ")
        if text:
            self.add(text.split("\n"))

    def add(self, lines: list[str]) -> None:
        if not lines:
            return
        if self.blank and self.lines:
            self.lines.append("")
        room = " " * min(self.indent, MOST_INDENT)
        for k, x in enumerate(lines):
            self.lines.append(((room[: -len(self.mark)] + self.mark if self.mark and not k else room) + x) if x else "")
        self.blank, self.mark = False, ""

    def gap(self) -> None:
        self.end_line()
        self.blank = True


def width(text: str) -> int:
    """Columns that a text takes in a fixed-width font."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


Item = tuple[Node | str, bool]


def _number(node: Node, name: str, most: int) -> int:
    s = node.attributes.get(name, "1")
    return max(1, min(int(s), most)) if s.isascii() and s.isdigit() and len(s) < 10 else 1


def table_rows(table: Node, seen: bool) -> tuple[list[Item], list[list[Item]]]:
    """What stands in a table outside its cells, and its rows' cells; each with whether its text is visible."""
    loose: list[Item] = []
    rows: list[list[Item]] = []
    todo = [(iter(table.children), seen)]
    while todo:  # rows in order, wherever the table's parts hold them
        children, seen = todo[-1]
        x = next(children, None)
        if x is None:
            todo.pop()
        elif isinstance(x, str) or not displayed(x):
            loose += [(x, seen)] if isinstance(x, str) else []
        elif x.name == "tr":
            now, own = [], shown(x, seen)
            for c in x.children:
                (now if isinstance(c, Node) and c.name in ("td", "th") else loose).append((c, own))
            rows.append([c for c in now if displayed(c[0])])
        elif x.name in SECTIONS or x.name == "form":
            todo.append((iter(x.children), shown(x, seen)))
        else:
            loose.append((x, seen))
    return loose, rows


def table_lines(rows: list[list[Item]], depth: int) -> list[str]:
    """The rows' lines with their columns aligned. A cell that spans rows stands in the first and keeps its place in the others."""
    until: list[int] = []  # by column: the first row that is free again
    placed: list[list[tuple[int, int, list[str]]]] = []
    for r, cells in enumerate(rows):
        at, now = 0, []
        for cell, seen in cells:
            while at < len(until) and until[at] > r:
                at += 1
            end = min(at + _number(cell, "colspan", MOST_COLUMNS), MOST_COLUMNS)
            if (down := _number(cell, "rowspan", MOST_ROWS)) > 1 and at < end:
                until += [0] * (end - len(until))
                until[at:end] = [r + down] * (end - at)
            lines = render([(c, shown(cell, seen)) for c in cell.children], depth)
            if any(lines):
                now.append((at, max(end, at + 1), lines))
            at = max(at, end)
        placed.append(now)
    starts = sorted({at for now in placed for at, _, _ in now})  # columns without text take no room
    wide = [0] * len(starts)
    spans = []
    for now in placed:
        for at, end, lines in now:
            a, b = bisect_right(starts, at) - 1, bisect_right(starts, end - 1)
            need = max((w for w in map(width, lines) if w <= WIDEST), default=0)
            if b - a == 1:
                wide[a] = max(wide[a], need)
            else:
                spans.append((b - a, a, b, need))
    for _, a, b, need in sorted(spans):
        wide[b - 1] += max(0, need - sum(wide[a:b]) - 2 * (b - a - 1))
    offset = {at: sum(wide[:k]) + 2 * k for k, at in enumerate(starts)}
    out: list[str] = []
    for now in placed:
        height = max((len(lines) for _, _, lines in now), default=0)
        parts: list[list[str]] = [[] for _ in range(height)]
        reached = [0] * height
        for at, _, lines in now:
            for k, line in enumerate(lines):
                if line:
                    gap = min(max(offset[at] - reached[k], 2 if reached[k] else 0), MOST_INDENT)
                    parts[k] += " " * gap, line
                    reached[k] += gap + width(line)
        out += ["".join(p).rstrip() for p in parts]
    return out


def render(items: list[Item], depth: int = 0) -> list[str]:
    """The lines of all visible text of some elements, laid out. depth: tables of several columns around them."""
    page = Page()
    lists: list[list] = []  # [ordered, next number] of the open lists
    exact: list[int] = []  # where the open preformatted elements begin among the page's parts
    todo: list[tuple[Node | str, bool, bool]] = [(x, seen, False) for x, seen in reversed(items)]
    while todo:
        x, seen, leave = todo.pop()
        if isinstance(x, str):
            if seen:
                page.exact(x) if exact else page.text(x)
            continue
        name = x.name
        if leave:
            if name in EXACT:
                a = exact.pop()
                page.parts[a:] = [own] if (own := "".join(page.parts[a:]).strip("\n")) else []
            if name == "q" and seen:
                page.exact("”")
            if name in LISTS:
                page.end_line()
                lists.pop()
                if not lists:
                    page.indent -= 2
                    page.gap()
            elif name in ("li", "dd"):
                page.end_line()
                page.indent -= 4 if name == "li" else 2
                page.mark = ""
            elif name in SPACED:
                page.gap()
            elif name in BLOCK:
                page.end_line()
            elif name == "text":  # each of a drawing's texts has a place of its own
                page.text(" ")
            continue
        if not displayed(x):
            continue
        seen = shown(x, seen)
        if name == "br":
            page.line_break()
        elif name == "hr":
            page.gap()
            page.add(["---"] if seen else [])
            page.gap()
        elif name == "img":
            page.text(x.attributes.get("alt", "") if seen else "")
        elif name == "input":
            page.text(x.attributes.get("value", "") if seen and x.attributes.get("type", "").lower() in SHOWN_INPUTS else "")
        else:
            if name == "table" and depth < DEEPEST:
                loose, rows = table_rows(x, seen)
                if any(len(r) > 1 for r in rows):
                    page.gap()
                    page.add([*render(loose, depth), *table_lines(rows, depth + 1)])
                    page.gap()
                    continue
            children = x.children
            if name == "details" and "open" not in x.attributes:
                children = [c for c in children if isinstance(c, Node) and c.name == "summary"]
            if name in LISTS:
                page.end_line() if lists else page.gap()
                page.indent += 0 if lists else 2
                lists.append([name == "ol", _number(x, "start", 10**9)])
            elif name == "li":
                page.end_line()
                mark = "- "
                if lists and lists[-1][0]:
                    lists[-1][1] = _number(x, "value", 10**9) if "value" in x.attributes else lists[-1][1]
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                page.indent, page.mark = page.indent + 4, mark.rjust(4)
            elif name == "dd":
                page.end_line()
                page.indent += 2
            elif name in SPACED:
                page.gap()
            elif name in BLOCK:
                page.end_line()
            elif name == "text":
                page.text(" ")
            if name in EXACT:
                exact.append(len(page.parts))
            if name == "q" and seen:
                page.exact("“")
            todo.append((x, seen, True))
            todo += [(c, seen, False) for c in reversed(children)]
    page.end_line()
    return page.lines


def to_text(page: str | None) -> str:
    return "\n".join(render([(c, True) for c in parse(page).children])).strip("\n") if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text."""
    schema = arrow_schema("page_id long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part["page_id"], pa.array([to_text(x) for x in part["html"].to_pylist()], pa.string())], schema=schema)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string")


def report(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines, text_sha256."""
    return extract(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
