"""HTML to text as it is laid out: a tree with implied tags, visibility rules, blocks, lists and aligned tables."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes"}
_UNSEEN = {"head", "title", "script", "style", "noscript", "template", "iframe", "noembed", "noframes", "datalist", "object", "svg", "canvas", "audio", "video", "select"}
_PARAGRAPH = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "table", "figure", "fieldset"}
_BLOCK = _PARAGRAPH | {
    "html", "body", "address", "article", "aside", "center", "dd", "details", "dialog", "dir", "div", "dt", "figcaption", "footer", "form",
    "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "section", "summary", "caption", "thead", "tbody", "tfoot", "tr", "td", "th",
}
#: A start tag closes the nearest open one of these, looking no further out than a barrier.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
_NO_P = _BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
#: Start tags that leave a head open; any other, and text, ends it.
_IN_HEAD = {"head", "html", "title", "meta", "link", "base", "basefont", "bgsound", "noframes", "noscript", "script", "style", "template"}
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_ATTRIBUTE = re.compile(r"(?P<name>[^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"(?P<double>[^\"]*+)\"?|'(?P<single>[^']*+)'?|(?P<bare>[^\s>\"'][^\s>]*+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
#: Elements nested deeper stay empty, their content goes to the parent, as in browsers; so a table lies in some 170 others at most.
_DEEPEST = 512
#: Columns and rows that a cell spans at most, by the HTML standard.
_WIDEST, _HIGHEST = 1000, 65_534
_SPACES = re.compile(r"[ \t\n\r\f]+")
_SPAN = re.compile(r"(?<![\w-])colspan\s*=\s*[\"']?\s*(\d+)", re.I)
_ROWS = re.compile(r"(?<![\w-])rowspan\s*=\s*[\"']?\s*(\d+)", re.I)
_START = re.compile(r"(?<![\w-])start\s*=\s*[\"']?\s*(-?\d{1,9})", re.I)
_VALUE = re.compile(r"(?<![\w-])value\s*=\s*[\"']?\s*(-?\d{1,9})", re.I)


def look(attrs: str, seen: bool) -> tuple[bool, bool]:
    """Whether an element and all in it is left out, and whether its text is seen, where that of its parent is `seen`.

    A `hidden` attribute or `display: none` leaves it out; `visibility` passes to what is inside, where it may be set
    anew. Of equal attributes the first counts, of equal declarations the last, but important ones before others."""
    if not attrs or not _MAY_HIDE.search(attrs):
        return False, seen
    style = None
    for m in _ATTRIBUTE.finditer(attrs):
        name = m["name"].lower()
        if name == "hidden":
            return True, seen
        if name == "style" and style is None:
            style = m["double"] or m["single"] or m["bare"] or ""
    now: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub(" ", html.unescape(style or "")).lower().split(";"):
        name, _, value = part.partition(":")
        value, mark, _ = value.partition("!")
        name = name.strip()
        if bool(mark) >= now.get(name, (False, ""))[0]:
            now[name] = bool(mark), value.strip()
    sight = now.get("visibility", (False, ""))[1]
    return now.get("display", (False, ""))[1] == "none", sight == "visible" if sight in ("visible", "hidden", "collapse") else seen


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


def build(source: str) -> Node:
    """The tree of a page; end tags that fit nothing are dropped, elements left open end with their parent."""
    root = Node("html")
    open_ = [root]

    def close(names: set[str], barriers: set[str]) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in names:
                del open_[i:]
                return
            if open_[i].tag in barriers:
                return

    def end_head() -> None:
        if open_[-1].tag == "head":
            open_.pop()
            body = Node("body")  # implied
            open_[-1].kids.append(body)
            open_.append(body)

    def text(s: str) -> None:
        if s.strip(" \t\n\r\f"):
            end_head()
        open_[-1].kids.append(html.unescape(s) if "&" in s else s)

    at = 0
    for m in iter(lambda: _MARKUP.search(source, at), None):
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        tag = m["tag"] and m["tag"].lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "br":
                end_head()
                open_[-1].kids.append(Node("br"))
            elif tag == "p" and not any(n.tag == "p" for n in open_):
                open_[-1].kids.append(Node("p"))
            else:
                close({tag}, {"td", "th", "table"} - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag})
            continue
        attrs = m["attrs"]
        if tag in ("html", "body") and any(n.tag == tag for n in open_) or tag == "head" and len(open_) > 1:
            continue
        if tag != "body" and tag not in _IN_HEAD:
            end_head()
        if tag in _NO_P:
            close({"p"}, {"td", "th", "table", "button"})
        if tag in _CLOSES:
            close(*_CLOSES[tag])
            if tag == "tr" and open_[-1].tag in ("td", "th"):
                close({"tr"}, {"table"})
            if tag in ("thead", "tbody", "tfoot"):
                close({"tr"}, {"table"})
            if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")  # implied
                open_[-1].kids.append(row)
                open_.append(row)
        node = Node(tag, attrs)
        open_[-1].kids.append(node)
        if tag in _RAW or tag in ("textarea", "title", "xmp"):
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            stop = end.start() if end else len(source)
            if tag not in _RAW:
                node.kids.append(html.unescape(source[at:stop]))
            at = end.end() if end else len(source)
        elif tag not in _VOID and not attrs.endswith("/") and len(open_) < _DEEPEST:
            open_.append(node)
    if at < len(source):
        text(source[at:])
    return root


class _Page:
    """Lines under construction; pending gaps open only once more text comes."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.mark = ""

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *more = s.split("\n")
            self._put(first)
            for x in more:
                self.flush(1, True)
                self._put(x)
            return
        flat = _SPACES.sub(" ", s)
        if flat[:1] == " ":
            self.space = True
        flat_ = flat.strip(" ")
        if flat_:
            self._put((" " if self.space and self.line else "") + flat_)
            self.space = flat[-1] == " "

    def _put(self, s: str) -> None:
        if s:
            self.line.append(s)

    def flush(self, gap: int, force: bool = False) -> None:
        s = "".join(self.line)
        if s.strip() or (force and self.lines):
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            head = self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.lines.append((head + s).rstrip())
            self.mark, self.gap = "", gap
        else:
            self.gap = max(self.gap, gap)
        self.line, self.space = [], False


def shown(s: str) -> int:
    """Columns that a line takes: two for wide characters, none for combining and formatting ones."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _span(found: re.Match | None, most: int) -> int:
    """A cell's span; 0 rows mean all that follow."""
    return 1 if found is None else min(most, int(found[1][:9]) or most)


def _table_lines(table: Node, seen: bool) -> list[str]:
    """Rows of a table, caption first. A cell is a block of lines, as wide as its column; columns are two blanks apart.

    A cell over several columns takes their widths, and what it needs beyond them widens the last one, so every cell
    begins where its column does; one over several rows stands in the first and keeps its columns free in the others.
    A column in which no cell shows anything, because it is empty or hidden, takes no room."""
    rows: list[list[tuple[list[str], int, int]]] = []
    lines: list[str] = []
    todo = [(n, seen) for n in reversed(table.kids)]

    def block(node: Node, seen: bool) -> list[str]:
        return render(node, seen).split("\n")

    while todo:
        n, sight = todo.pop()
        if isinstance(n, str):
            if n.strip() and sight:
                lines.append(_SPACES.sub(" ", n).strip())
            continue
        gone, sight = look(n.attrs, sight)
        if gone or n.tag in _UNSEEN:
            continue
        if n.tag == "tr":
            cells = []
            for c in n.kids:
                if isinstance(c, str):
                    if c.strip() and sight:
                        cells.append(([_SPACES.sub(" ", c).strip()], 1, 1))
                    continue
                if c.tag not in ("td", "th"):
                    own = block(c, sight)
                    if own != [""]:
                        cells.append((own, 1, 1))
                    continue
                gone, own_sight = look(c.attrs, sight)
                if not gone:
                    inside = Node("div")
                    inside.kids = c.kids
                    wide, high = max(1, min(_WIDEST, int(m[1][:9]))) if (m := _SPAN.search(c.attrs)) else 1, _span(_ROWS.search(c.attrs), _HIGHEST)
                    cells.append((block(inside, own_sight), wide, high))
            if cells:
                rows.append(cells)
        elif n.tag in ("thead", "tbody", "tfoot"):
            todo += [(kid, sight) for kid in reversed(n.kids)]
        elif n.tag != "colgroup":
            own = block(n, sight)
            lines += own if own != [""] else []

    taken: dict[int, int] = {}  # rows for which a column is still held by a cell from above
    placed: list[list[tuple[int, list[str], int]]] = []
    for cells in rows:
        at, row, held = 0, [], {}
        for own, wide, high in cells:
            while taken.get(at, 0):
                at += 1
            row.append((at, own, wide))
            if high > 1:
                held |= {i: high - 1 for i in range(at, at + wide)}
            at += wide
        taken = {i: n - 1 for i, n in taken.items() if n > 1} | held
        placed.append(row)
    # columns between the same neighbouring borders of cells are one segment; a cell is a range of segments
    full = [(at, own, wide) for row in placed for at, own, wide in row if any(own)]
    borders = sorted({b for at, _, wide in full for b in (at, at + wide)})
    number = {b: k for k, b in enumerate(borders)}
    width, used = [0] * len(borders), [0] * len(borders)
    for at, own, wide in sorted(full, key=lambda c: c[2]):
        first, last = number[at], number[at + wide]
        need = max(map(shown, own)) - sum(width[first:last]) - 2 * (wide - 1)
        width[last - 1] += max(0, need)
        for k in range(first, last):
            used[k] = 1
    start, x = [], 0
    for k, b in enumerate(borders[1:]):
        start.append(x)
        x += used[k] * (width[k] + 2 * (b - borders[k]))
    for row in placed:
        for k in range(max(len(own) for _, own, _ in row)):
            out, end = [], 0
            for at, own, _ in row:
                if k < len(own) and own[k]:
                    out.append(" " * (start[number[at]] - end) + own[k])
                    end = start[number[at]] + shown(own[k])
            lines.append("".join(out).rstrip())
    return lines


def render(root: Node, seen: bool = True) -> str:
    """The visible text below a node, walked with an own stack, so that depth has no limit but memory."""
    page = _Page()
    stack: list[tuple] = [("in", root, False, seen)]
    counters: list[list[int] | None] = []  # of the open lists: the next number and the step to the one after it
    while stack:
        what, node, pre, seen = stack.pop()
        if what == "text":
            if seen:
                page.text(node, pre)
        elif what == "out":
            if node.tag in _BLOCK:
                page.flush(2 if node.tag in _PARAGRAPH else 1)
            if node.tag in ("ul", "ol", "menu"):
                counters.pop()
                if counters:
                    page.gap = 1
            if node.tag in ("li", "dd", "blockquote"):
                page.indent, page.mark = pre if isinstance(pre, tuple) else ("", "")
                page.mark = ""
        else:
            tag = node.tag
            gone, seen = look(node.attrs, seen)
            if gone or tag in _UNSEEN:
                continue
            if tag == "br":
                page.flush(1, True)
                continue
            if tag == "hr":
                page.flush(2)
                continue
            after = pre
            if tag in _BLOCK:
                page.flush(2 if tag in _PARAGRAPH else 1)
                if tag in ("ul", "ol", "menu"):
                    if counters:
                        page.gap = min(page.gap, 1)
                    start = _START.search(node.attrs)
                    back = any(m["name"].lower() == "reversed" for m in _ATTRIBUTE.finditer(node.attrs))
                    first = int(start[1]) if start else sum(not isinstance(k, str) and k.tag == "li" for k in node.kids) if back else 1
                    counters.append([first, -1 if back else 1] if tag == "ol" else None)
                elif tag in ("li", "dd", "blockquote"):
                    after = (page.indent, page.mark)
                    mark = "  "
                    if tag == "li":
                        number = counters[-1] if counters else None
                        if number is not None:
                            value = _VALUE.search(node.attrs)
                            number[0] = int(value[1]) if value else number[0]
                            mark = f"{number[0]}. "
                            number[0] += number[1]
                        else:
                            mark = "- "
                    page.indent += " " * len(mark)
                    page.mark = mark if tag == "li" else ""
                elif tag == "table":
                    for line in _table_lines(node, seen):
                        if line:
                            page.line.append(line)
                            page.flush(1)
                        else:  # a gap inside a cell
                            page.gap = 2
                    page.flush(2)
                    continue
            keep = tag == "pre" or (pre if isinstance(pre, bool) else False)
            stack.append(("out", node, after, seen))
            for kid in reversed(node.kids):
                stack.append(("text" if isinstance(kid, str) else "in", kid, keep, seen))
    page.flush(0)
    return "\n".join(page.lines).strip("\n")


def to_text(source: str | None) -> str:
    return render(build(source)) if source else ""


def text_batches(batches: Iterable[pa.RecordBatch], column: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            texts = [to_text(x) for x in part.column(part.schema.names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])


def extract_text(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """pages with the text of their html as laid out, in column `out` (replaced if there).

    A null or empty page has an empty text. Markup that is broken never fails: stray end tags are dropped, open
    elements end with their parent, an unended comment or tag ends with the page. Equal pages have equal texts, pages
    of any length are rendered whole, and an empty table stays empty."""
    pages = pages.drop(out) if out != column else pages
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInArrow(lambda it: text_batches(it, column, out), f"{fields}, `{out}` string")
