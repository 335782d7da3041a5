"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and block layout.

All text that a browser would show is emitted: paragraphs apart by an empty line, lists with their
markers and nesting, tables with their cells aligned in columns, whatever columns and rows these span. Text
that isn't visible doesn't appear, but what is visible again inside of it does.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Generator, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, tidied

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist iframe embed video audio canvas noembed noframes area param rp".split())
#: Not shown in svg and in math. Of svg's other elements only text and foreignobject show text.
UNSEEN_SVG, UNSEEN_MATH = frozenset("defs symbol clippath mask pattern marker desc metadata".split()), frozenset("annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
APART = frozenset("article aside blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr main menu nav ol p pre section table ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table td th caption button html template object".split())
#: What a start tag implicitly ends, and where looking for it stops.
IMPLIES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*?)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_WHITE = re.compile(r"[ \t\n\f\r]+")


#: Elements that can be open at once, as in browsers: what is nested deeper stands beside the deepest one.
DEPTH = 512


class Node:
    __slots__ = ("tag", "kids", "hidden", "faint", "start", "value", "foreign", "spans")

    def __init__(self, tag: str, attrs: str = "", within: str = "", faint: bool = False):
        self.tag = tag
        # Not visible, though it has its place: what is in it may be visible again, unlike in what is hidden.
        self.faint = faint
        self.spans: tuple[int, int] | None = None
        # What the text in it belongs to: "svg" (not shown), "svg text", "math", or "" for HTML.
        self.foreign = tag if tag in ("svg", "math") else "" if tag == "foreignobject" else "svg text" if within == "svg" and tag == "text" else within
        self.kids: list[Node | str] = []
        self.hidden = tag in HIDDEN or tag in (UNSEEN_SVG if within.startswith("svg") else UNSEEN_MATH if within == "math" else ())
        self.start = self.value = None
        if attrs:
            found = {a.lower(): html.unescape(x or y or z) for a, x, y, z in reversed(_ATTR.findall(attrs))}
            style = found.get("style", "")
            if seen := _VISIBILITY.findall(style):
                self.faint = seen[-1].lower() != "visible"
            if tag in ("td", "th"):
                self.spans = tuple(int(x) if (x := found.get(c, "").strip()).isdecimal() else 1 for c in ("colspan", "rowspan"))
            self.hidden = self.hidden or "hidden" in found or bool(_NONE.search(style)) or (tag == "input" and found.get("type", "").lower() == "hidden")
            self.start, self.value = found.get("start"), found.get("alt") if tag == "img" else found.get("value")
            if tag == "details" and "open" not in found:
                self.start = "closed"
            self.hidden = self.hidden or (tag == "dialog" and "open" not in found)
        else:
            self.hidden = self.hidden or tag == "dialog"


def parse(page: str) -> Node:
    """The tree of a page: implied ends of p, li, table parts and others, stray end tags left out, text kept as it stands."""
    root = Node("html")
    stack = [root]

    def close(names: set[str], stop: set[str] | frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in stop:
                return

    def text(part: str) -> None:
        if part and stack[-1].foreign != "svg" and not stack[-1].faint:
            if stack[-1].tag == "head" and part.strip():
                stack.pop()
            stack[-1].kids.append(html.unescape(part))

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].kids.append(Node("p"))
            elif tag in HEADINGS:
                close(set(HEADINGS), SCOPE)
            else:
                close({tag}, set() if tag in ("table", "html", "body", "template") else SCOPE - {tag})
        elif m[2]:
            tag = m[2].lower()
            if tag == "html":
                continue
            if stack[-1].tag == "head" and tag not in ("title", "style", "script", "meta", "link", "base", "noscript", "template"):
                stack.pop()
            if tag in CLOSES_P:
                close({"p"}, SCOPE)
            if tag in IMPLIES:
                while True:
                    before = len(stack)
                    close(*IMPLIES[tag])
                    if len(stack) == before or tag in ("li", "dt", "dd"):
                        break
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            if tag in ("a", "button"):
                close({tag}, SCOPE)
            within = stack[-1].foreign
            node = Node(tag, m[3], within, stack[-1].faint)
            if node.faint and tag in ("img", "input"):
                node.value = None
            stack[-1].kids.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                raw, at = page[at : end.start() if end else n], end.end() if end else n
                if not node.faint:
                    node.kids.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            elif tag not in VOID and not ((within or node.foreign) and (m[3] or "").rstrip().endswith("/")):
                if len(stack) < DEPTH or (node.hidden and not stack[-1].hidden):
                    stack.append(node)
    return root


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines of text under construction: inline text joins with white space collapsed, blocks break."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = False

    def add(self, text: str) -> None:
        self.now.append(text)

    def end(self) -> None:
        line = _WHITE.sub(" ", "".join(self.now)).strip(" ")
        self.now = []
        if line:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.done:
            self.done.append("")
        self.gap = False
        self.done.append(line)

    def apart(self) -> None:
        self.end()
        self.gap = True


def layout(root: Node) -> list[str]:
    """Lines of a tree. Lists and tables in it are laid out by generators of their own, each waiting for the one it yields."""
    stack, lines = [_render(root, 0)], None
    while stack:
        try:
            stack.append(stack[-1].send(lines))
            lines = None
        except StopIteration as done:
            stack.pop()
            lines = done.value
    return lines


Layout = Generator["Layout", list[str], list[str]]


def _render(node: Node, depth: int) -> Layout:
    out = Lines()
    # Frames of (node, child index); deep trees of blocks need no recursion, only nested lists and tables do.
    stack: list[list] = [[node, 0]]
    while stack:
        frame = stack[-1]
        this, i = frame
        if i >= len(this.kids):
            stack.pop()
            if stack and this.tag in BLOCK:
                out.apart() if this.tag in APART else out.end()
            elif this.tag == "text" and this.foreign:
                out.add(" ")
            continue
        frame[1] += 1
        kid = this.kids[i]
        if isinstance(kid, str):
            if this.tag not in ("ul", "ol", "dl", "select", "html") or kid.strip():
                out.add(kid)
            continue
        if kid.hidden:
            continue
        tag = kid.tag
        if tag == "br":
            if out.now:
                out.end()
        elif tag == "hr":
            out.apart()
        elif tag == "img":
            out.add(kid.value or "")
        elif tag == "input":
            out.add(" " + (kid.value or "") + " ")
        elif tag == "pre":
            out.apart()
            for line in _plain(kid).strip("\n").split("\n"):
                out.put(line.rstrip())
            out.apart()
        elif tag in ("ul", "ol", "menu"):
            out.apart() if not depth else out.end()
            for line in (yield _list(kid, depth)):
                out.put(line)
            out.apart() if not depth else out.end()
        elif tag == "table":
            out.apart()
            for line in (yield _table(kid, depth)):
                out.put(line)
            out.apart()
        elif tag == "details" and kid.start == "closed":
            out.end()
            short = Node("div")
            short.kids = [x for x in kid.kids if isinstance(x, Node) and x.tag == "summary"][:1]
            stack.append([short, 0])
        else:
            if tag in BLOCK:
                out.apart() if tag in APART else out.end()
            elif tag in ("q",):
                out.add('"')
            elif tag == "text" and kid.foreign:
                out.add(" ")
            stack.append([kid, 0])
    out.end()
    return out.done


def _plain(node: Node) -> str:
    out, stack = [], [iter(node.kids)]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
        elif isinstance(kid, str):
            out.append(kid)
        elif kid.tag == "br":
            out.append("\n")
        elif not kid.hidden:
            stack.append(iter(kid.kids))
    return "".join(out).replace("\r\n", "\n").replace("\r", "\n")


def _list(node: Node, depth: int) -> Layout:
    try:
        number = int(node.start) if node.tag == "ol" and node.start else 1
    except ValueError:
        number = 1
    out: list[str] = []
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip():
                out.append(_WHITE.sub(" ", kid).strip())
            continue
        if kid.hidden:
            continue
        if kid.tag != "li":
            box = Node("div")
            box.kids = [kid]
            out += ["  " + x if x else x for x in (yield _render(box, depth + 1))]
            continue
        if node.tag == "ol":
            number = int(kid.value) if (kid.value or "").isdigit() else number
            mark, number = f"{number}. ", number + 1
        else:
            mark = "- "
        body = [x for x in (yield _render(kid, depth + 1)) if x]
        for j, line in enumerate(body or ([] if kid.faint else [""])):
            out.append((mark + line).rstrip() if not j else " " * len(mark) + line)
    return out


def _table(node: Node, depth: int) -> Layout:
    captions: list[str] = []
    rows: list[list[tuple[list[str], int, int]] | None] = []
    todo: list[Node | str] = list(reversed(node.kids))
    loose: list[Node | str] = []
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            if kid.strip():
                loose.append(kid)
        elif kid.tag == "colgroup":
            rows.append(None)
        elif kid.hidden or kid.tag == "col":
            continue
        elif kid.tag == "caption":
            captions += [x for x in (yield _render(kid, depth + 1)) if x]
        elif kid.tag in ("tbody", "thead", "tfoot"):
            rows.append(None)  # cells don't span into another group of rows
            todo += reversed([*kid.kids, Node("colgroup")])
        elif kid.tag == "tr":
            cells = []
            for c in kid.kids:
                if isinstance(c, Node) and not c.hidden and c.tag in ("td", "th"):
                    cells.append(([x for x in (yield _render(c, depth + 1)) if x], *(c.spans or (1, 1))))
            stray = [x for x in kid.kids if (x.strip() if isinstance(x, str) else not x.hidden and x.tag not in ("td", "th"))]
            if stray:
                loose += stray
            rows.append(cells)
        else:
            loose.append(kid)
    out = captions
    if loose:  # what isn't in a cell stands before the table
        box = Node("div")
        box.kids = loose
        out = [x for x in (yield _render(box, depth + 1)) if x] + out
    return out + _grid(rows)


#: The most columns and rows that a cell spans, as in browsers.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def _grid(rows: list[list[tuple[list[str], int, int]] | None]) -> list[str]:
    """The lines of a table's rows of (lines, columns, rows) cells, in aligned columns; None ends a group of rows.

    A cell stands in the first row and column of those it spans, and the cells after it, in this row and the next ones, go beside it.
    Columns in which no cell starts take no room; a cell wider than its columns widens the last of them.
    """
    placed, taken = [], {}  # taken: column -> the last row that a cell from above reaches there
    for i, r in enumerate(rows):
        if r is None:
            taken = {}
            continue
        line, free = [], 0
        for text, across, down in r:
            while taken.get(free, -1) >= i:
                free += 1
            across, down = min(max(across, 1), MOST_COLUMNS), min(down, MOST_ROWS) or MOST_ROWS
            line.append((free, free + across, text))
            if down > 1:
                taken |= dict.fromkeys(range(free, free + across), i + down - 1)
            free += across
        placed.append(line)
    starts = sorted({begin for line in placed for begin, _, _ in line})
    number = {c: i for i, c in enumerate(starts)}
    wide = [0] * len(starts)
    cells = [(number[begin], max(bisect_left(starts, end), number[begin] + 1), max(map(width, text), default=0)) for line in placed for begin, end, text in line]
    for begin, end, n in sorted(cells, key=lambda c: c[1] - c[0]):
        have = sum(wide[begin:end]) + 2 * (end - begin - 1)
        wide[end - 1] += max(n - have, 0)
    at = list(accumulate((w + 2 for w in wide[:-1]), initial=0))
    out = []
    for line in placed:
        for j in range(max((len(text) for _, _, text in line), default=0)):
            shown, done = "", 0
            for begin, _, text in line:
                if j < len(text):
                    shown += " " * (at[number[begin]] - done) + text[j]
                    done = at[number[begin]] + width(text[j])
            out.append(shown.rstrip())
    return out


def page_text(page: str) -> str:
    return "\n".join(layout(parse(page)))


def extracted(pages: DataFrame, source: str = "html", into: str = "text") -> DataFrame:
    """pages with the visible text of `source` in place of that column.

    A null page is null, an empty one or one without visible text the empty string; unclosed tags and
    comments end with the page; elements nested deeper than DEPTH count as siblings of the deepest. Repeated rows
    stay, other columns pass through whatever their names. Rows are independent: no shuffle, and memory is bounded by a batch of pages.
    """
    kept = [c for c in pages.columns if c not in (source, into)]
    schema = pages.select(*kept).schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [None if p is None else page_text(p) for p in column(b, source)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(text, pa.string())], names=[*kept, into])

    return pages.select(*kept, F.col(source).cast("string").alias(source)).mapInArrow(tidied(run), schema)
