"""Layout-aware text of HTML pages.

A small tree builder (implied end tags, void elements, raw-text elements) feeds a renderer that
emits all visible text: blank lines between paragraphs, headings and tables, one line per block,
list markers with indentation, table cells padded to common columns, ``pre`` text as it is.
Hidden elements (``hidden``, ``display:none``, ``visibility:hidden``) and elements that are never
shown (``script``, ``style``, ``template``, ``head`` …) give nothing. Both steps use explicit
stacks, so nesting of any depth works, and cost about the length of the page.

Defined results: NULL or empty HTML gives an empty text. Broken markup is read like a browser
would: stray end tags are ignored, open elements end with the page. Repeated rows are rendered
one by one. Only the id and the HTML column are read, so other columns cannot clash.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|[^<]+|<", re.S)
TAG = re.compile(r"<(/?)[a-zA-Z]")
NAME_END = re.compile(r"[\s/>]")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
BLANK = re.compile(r"[ \t\n\r\f]+")

# Fixed values of the HTML standard: element classes and which open elements a start tag ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER = set(
    "script style head template noscript iframe object svg math datalist noembed noframes audio video canvas select".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr fieldset".split())
BLOCK = SPACED | set(
    "html body div section article aside header footer nav main address form li dt dd tr caption "
    "thead tbody tfoot details summary figcaption legend center dialog hgroup search menu".split()
)
ENDS_P = BLOCK - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption"}
# start tag: (open elements it ends, elements that bound the search)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
P_BOUNDS = {"table", "td", "th", "button", "object", "caption", "html"}
MAX_COLUMN = 40  # cells wider than this are not padded for, so a page grows by its cells only
MAX_SPAN = 1000  # the standard takes larger spans as 1000


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


class TagEnds:
    """Finds the ``>`` of tags, past quoted attributes. However many tags never end, a page is read a bounded number
    of times: a quote that led nowhere once is known, and so is the next quote or ``>`` behind the place searched last."""

    def __init__(self, page: str):
        self.page = page
        self.near = {}  # per pattern: searched from, found
        self.closing = {'"': len(page), "'": len(page)}  # from here on no such quote
        self.lost: set[int] = set()

    def next(self, pattern: re.Pattern, at: int) -> int:
        """The next character of a kind, or the end of the page."""
        start, found = self.near.get(pattern, (0, -1))
        if not start <= at <= found:
            match = pattern.search(self.page, at)
            found = match.start() if match else len(self.page)
            self.near[pattern] = (at, found)
        return found

    def after(self, at: int) -> int:
        """Where the ``>`` stands of a tag whose name ends at ``at``; -1 if it has none."""
        seen = []
        while True:
            at = self.next(STOP, at)
            if at == len(self.page) or at in self.lost:
                break
            quote = self.page[at]
            if quote == ">":
                return at
            seen.append(at)
            if at + 1 >= self.closing[quote]:
                break
            end = self.page.find(quote, at + 1)
            if end < 0:
                self.closing[quote] = at + 1
                break
            at = end + 1
        self.lost.update(seen)
        return -1


def build(page: str) -> Node:
    """The element tree of a page; text nodes are plain strings."""
    root = Node("html")
    stack = [root]
    open_tags: dict[str, int] = {"html": 1}

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    def close(tags: set[str], bounds: set[str]) -> None:
        """End the outermost open element of ``tags`` above the nearest bound."""
        if not any(open_tags.get(t) for t in tags):
            return
        found = None
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in bounds:
                break
            if stack[at].tag in tags:
                found = at
        if found is not None:
            while len(stack) > found:
                pop()

    at, size = 0, len(page)
    ends = TagEnds(page)
    while at < size:
        token = TAG.match(page, at)
        named = ends.next(NAME_END, token.end()) if token else size
        stop = ends.after(named)
        if stop >= 0:
            name, attrs, at = page[token.end() - 1 : named], page[named:stop], stop + 1
        else:
            text = OTHER.match(page, at)[0]
            at += len(text)
            if text[0] != "<" or text == "<":
                stack[-1].children.append(html.unescape(text))
            continue
        name = name.lower()
        if token[1]:
            if name == "p" and not open_tags.get("p"):
                stack[-1].children.append(Node("p"))
            elif name == "br":
                stack[-1].children.append(Node("br"))
            elif open_tags.get(name) and name != "html":
                close_at = len(stack) - 1
                while stack[close_at].tag != name:
                    close_at -= 1
                while len(stack) > close_at:
                    pop()
            continue
        if name == "html":
            continue
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ENDS_P and open_tags.get("p"):
            close({"p"}, P_BOUNDS)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID or (node.attrs.endswith("/") and name in ("svg", "math", "path", "use")):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else size
            body = page[at:stop]
            node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
            gt = page.find(">", stop) if end else -1
            at = gt + 1 if gt >= 0 else size
            continue
        stack.append(node)
        open_tags[name] = open_tags.get(name, 0) + 1
    return root


def attributes(node: Node) -> dict[str, str]:
    if not node.attrs:
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attrs)}


def visible(node: Node, attrs: dict[str, str]) -> bool:
    if node.tag in NEVER or "hidden" in attrs:
        return False
    if node.tag == "input" and attrs.get("type", "").lower() == "hidden":
        return False
    return not HIDING.search(attrs.get("style", ""))


class Flow:
    """Lines of one formatting context (the page or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.prefix = ""  # marker of a list item, for its first line
        self.indent = ""
        self.gap = False  # a blank line is due before the next line
        self.space = False

    def text(self, value: str) -> None:
        value = BLANK.sub(" ", value)
        if value[:1] == " ":
            self.space, value = True, value[1:]
        if not value:
            return
        if self.parts and self.space:
            self.parts.append(" ")
        self.space = value[-1] == " "
        self.parts.append(value[:-1] if self.space else value)

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent[: len(self.indent) - len(self.prefix)] + self.prefix + line) if self.prefix else self.indent + line)
        self.prefix = ""

    def end_line(self, spaced: bool = False) -> None:
        if self.parts:
            self._put("".join(self.parts))
            self.parts = []
        self.space = False
        self.gap = self.gap or spaced

    def line_break(self) -> None:
        if self.parts or self.prefix:
            self.end_line()
        elif self.lines and self.lines[-1] != "":
            self.lines.append("")

    def whole(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end_line()
        for line in lines:
            self._put(line)


def columns(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (cell, span) as lines with the cells of a column under each other."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for cell, span in row:
            if span == 1 and len(cell) <= MAX_COLUMN:
                widths[at] = max(widths.get(at, 0), len(cell))
            else:
                widths.setdefault(at, 0)
            at += span
    known = sorted(widths)  # columns in which a cell begins; others take no room
    out = []
    for row in rows:
        at, cells = 0, []
        for cell, span in row:
            under = known[bisect_left(known, at) : bisect_left(known, at + span)]
            cells.append(cell.ljust(sum(widths[c] for c in under) + 3 * (len(under) - 1)))
            at += span
        line = " | ".join(cells).rstrip(" |")
        if line:
            out.append(line)
    return out


def render(page: str | None) -> str:
    """All visible text of a page."""
    if not page:
        return ""
    flow, outer = Flow(), []  # outer: flows around the open table cells
    tables: list[list[list[tuple[str, int]]]] = []
    lists: list[list] = []  # [ordered, next number]
    in_pre = 0
    work: list[tuple] = [("open", build(page))]
    while work:
        what, node = work.pop()
        if what == "text":
            if in_pre:
                first, *more = node.split("\n")
                flow.parts.append(first)
                for line in more:
                    flow._put("".join(flow.parts))
                    flow.parts = [line]
            else:
                flow.text(node)
            continue
        tag = node.tag
        if what == "open":
            attrs = attributes(node)
            if not visible(node, attrs):
                continue
            if tag == "br":
                flow.line_break()
                continue
            if tag == "title":
                continue
            if tag == "wbr" or (tag in VOID and tag != "hr"):
                continue
            if tag in BLOCK and tag not in ("tr", "thead", "tbody", "tfoot"):
                flow.end_line(tag in SPACED and not (lists and tag in ("ul", "ol")))
            if tag in ("ul", "ol", "menu"):
                start = attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                marker = "- "
                if lists and lists[-1][0]:
                    marker = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indent += " " * len(marker)
                flow.prefix = marker
                node.attrs = marker
            elif tag in ("blockquote", "dd"):
                flow.indent += "  "
            elif tag == "pre":
                in_pre += 1
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                span = attrs.get("colspan", "1")
                node.attrs = str(min(MAX_SPAN, max(1, int(span)))) if re.fullmatch(r"\d{1,6}", span) else "1"
                outer.append((flow, lists, in_pre))
                flow, lists, in_pre = Flow(), [], 0
            work.append(("close", node))
            for child in reversed(node.children):
                work.append(("text" if isinstance(child, str) else "open", child))
            continue
        if tag in ("td", "th") and tables and outer:
            flow.end_line()
            cell = " ".join(line.strip() for line in flow.lines if line.strip())
            flow, lists, in_pre = outer.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((cell, int(node.attrs)))
            continue
        if tag == "table" and tables:
            flow.whole(columns(tables.pop()))
        elif tag == "pre":
            in_pre = max(0, in_pre - 1)
        if tag in BLOCK and tag not in ("tr", "thead", "tbody", "tfoot"):
            flow.end_line()
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        elif tag == "li":
            flow.indent = flow.indent[: -len(node.attrs)] if node.attrs else flow.indent
            flow.prefix = ""
        elif tag in ("blockquote", "dd"):
            flow.indent = flow.indent[:-2]
        if tag in SPACED and not (lists and tag in ("ul", "ol")):
            flow.gap = True
    flow.end_line()
    return "\n".join(line.rstrip() for line in flow.lines).strip("\n")


def extract(df: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """The id as ``key_`` and the visible text of every page."""
    pages = df.select(F.col(f"`{key}`").alias("key_"), F.col(f"`{markup}`").cast("string").alias("html_"))
    kind = pages.schema["key_"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([render(page.as_py()) for page in batch.column("html_")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key_"), out], names=["key_", "text"])

    return pages.mapInArrow(texts, f"key_ {kind}, text string")
