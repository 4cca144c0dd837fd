"""Visible text of web pages, laid out as a browser would: blocks, lists and aligned tables."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names that HTML gives a role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template noscript title textarea iframe noembed noframes xmp".split())
HIDDEN = set("head script style template noscript title iframe noembed noframes datalist object audio video canvas svg math select".split())
HEAD = set("base basefont bgsound link meta title noscript noframes style script template".split())  # what a head can hold
FOREIGN = {"svg", "math"}  # only they and what is inside can be closed by a slash in the opening tag
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure table ul ol dl hr fieldset".split())
BLOCKS = PARAGRAPHS | set("address article aside body center details dialog dd div dt figcaption footer form header html legend li main menu nav section summary caption".split())
CELLS, SECTIONS, LISTS = {"td", "th"}, {"thead", "tbody", "tfoot"}, {"ul", "ol", "menu"}
#: An opening tag ends these elements, if one is open above the nearest boundary.
ENDS = {"li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
ENDS |= {c: (CELLS, {"table", "tr"}) for c in CELLS} | {s: (SECTIONS | {"tr", "caption", "colgroup"}, {"table"}) for s in SECTIONS}
ENDS |= {b: ({"p"}, {"table", "td", "th", "caption", "button"}) for b in BLOCKS - {"li", "dt", "dd", "caption"}}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
MARKS = re.compile("[>\"']")
INSIDE = re.compile(r"""((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
UNQUOTED_END = re.compile(r"""=\s*[^\s"'>]+\Z""")
GONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
SPACES = re.compile(r"[\x20\t\n\r\f]+")


class Tags:
    """Tags of a page from left to right, each place looked at a bounded number of times.

    A tag ends at the first ``>`` outside quotes; a ``<`` from which none is in sight is text.  After the first such one the
    end seen from each quote is worked out once, from the end of the page, so that no further search runs in vain.
    """

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.marks: list[int] | None = None

    def _prepare(self) -> None:
        source = self.source
        self.marks = [m.start() for m in MARKS.finditer(source, 0, self.last + 1)]
        self.ends = [-1] * (len(self.marks) + 1)
        following = {'"': -1, "'": -1}  # the next quote of each kind, as a place among the marks
        for k in range(len(self.marks) - 1, -1, -1):
            mark = source[self.marks[k]]
            if mark == ">":
                self.ends[k] = self.marks[k]
            else:
                partner, following[mark] = following[mark], k
                self.ends[k] = self.ends[partner + 1] if partner >= 0 else -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start, end, name of a closing tag, name and attributes of an opening one; comments have no names."""
        source = self.source
        while (lt := source.find("<", at)) >= 0:
            if source.startswith("!--", lt + 1):
                end = source.find("-->", lt + 4)
                return lt, end + 3 if end >= 0 else len(source), "", "", ""
            if lt > self.last:
                lt = source.find("<!--", lt)
                return (lt, len(source), "", "", "") if lt >= 0 else None
            kind = source[lt + 1 : lt + 2]
            if kind in ("!", "?"):
                return lt, source.find(">", lt) + 1, "", "", ""
            name = NAME.match(source, lt + 1 + (kind == "/"))
            if name and kind == "/":
                return lt, source.find(">", name.end()) + 1, name[0], "", ""
            if name:
                if self.marks is None and (whole := INSIDE.match(source, name.end())):
                    return lt, whole.end(), "", name[0], whole[1]
                if self.marks is None:
                    self._prepare()
                end = self.ends[bisect_left(self.marks, name.end())]
                if end >= 0:
                    return lt, end + 1, "", name[0], source[name.end() : end]
            at = lt + 1
        return None

    def raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """Where the text of an element that holds no tags ends, and where its closing tag does."""
        found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(self.source, at, max(at, self.last + 1))
        return found.span() if found else (len(self.source), len(self.source))


class Flow:
    """Lines of one block of text, page or table cell, as they grow."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is open
        self.blank = False  # whether an empty line is due before the next text
        self.indent = 0
        self.mark = ""  # of a list item, for its first line

    def write(self, text: str, kept: bool) -> None:
        if kept:
            first, *others = text.split("\n")
            self.parts.append(first)
            for line in others:
                self.end_line(always=True)
                self.parts.append(line)
            return
        text = SPACES.sub(" ", text)
        if text[:1] == " " and (not self.parts or self.parts[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.parts.append(text)

    def end_line(self, always: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts.clear()
        if line:
            if self.blank and self.lines:
                self.lines.append("")
            lead = " " * max(0, self.indent - len(self.mark)) + self.mark if self.mark else " " * self.indent
            self.lines.append(lead + line)
            self.mark, self.blank = "", False
        elif always and self.lines and not self.blank:
            self.lines.append("")

    def gap(self) -> None:
        self.end_line()
        self.blank = True

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # of each cell: columns and rows spanned, lines
        self.caption: list[str] = []

    def _placed(self) -> list[list[tuple[int, list[str]]]]:
        """Cells of each row with empty ones where a cell of an earlier row reaches down."""
        down: dict[int, int] = {}  # rows that a column is still taken for
        out = []
        for row in self.rows:
            cells: list[tuple[int, list[str]]] = []
            at, after = 0, {c: n - 1 for c, n in down.items() if n > 1}
            for span, rows, lines in row:
                while at in down:
                    cells.append((1, []))
                    at += 1
                cells.append((span, lines))
                if rows > 1:
                    after |= dict.fromkeys(range(at, at + span), rows - 1)
                at += span
            out.append(cells)
            down = after
        return out

    def lines(self) -> list[str]:
        """Rows with their cells side by side, each column as wide as its widest single cell, two spaces apart."""
        width: dict[int, int] = {}
        placed = self._placed()
        for row in placed:
            at = 0
            for span, lines in row:
                if span == 1:
                    width[at] = max([width.get(at, 0), *map(len, lines)])
                at += span
        out = list(self.caption)
        for row in placed:
            for k in range(max((len(lines) for _, lines in row), default=0)):
                at, text = 0, ""
                for span, lines in row:
                    room = sum(width.get(c, 0) + 2 for c in range(at, at + span))
                    text += (lines[k] if k < len(lines) else "").ljust(room - 2) + "  "
                    at += span
                out.append(text.rstrip())
        return out


class Page:
    """Builds the tree of open elements, with the tags that authors leave out, and lays its text out on the way."""

    def __init__(self):
        self.open: list[str] = []
        self.places: dict[str, list[int]] = {}  # of each element that is open, from the outermost
        self.hidden: list[tuple[bool, bool]] = []  # of each: not laid out at all, laid out but invisible
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.lists: list[int | None] = []  # next number, or None for bullets
        self.pre = 0
        self.headed = False  # whether the head has come, or what ends it

    def start(self, tag: str, attributes: dict[str, str], empty: bool = False) -> None:
        if tag == "head" and self.headed:
            return
        if tag not in HEAD | {"html", "head"}:
            self._end_head()
        self.headed = self.headed or tag == "head"
        if empty and (tag in FOREIGN or self.is_foreign()):
            return
        if tag in ENDS:
            self._imply_end(*ENDS[tag])
        if tag in CELLS and not self._in_table("tr") and self._is_open("table"):
            self.start("tr", {})
        if tag in CELLS | SECTIONS | {"tr", "caption"} and not self._is_open("table"):
            return
        gone, unseen = self.hidden[-1] if self.hidden else (False, False)
        style = attributes.get("style", "")
        gone = gone or tag in HIDDEN or "hidden" in attributes or bool(GONE.search(style))
        if stated := VISIBILITY.findall(style):
            unseen = stated[-1].lower() != "visible"
        hidden = gone or unseen
        if tag in VOID:
            if tag == "br" and not hidden:
                self.flows[-1].end_line(always=True)
            elif tag == "hr":
                self.flows[-1].gap()
            return
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(tag)
        self.hidden.append((gone, unseen))
        flow = self.flows[-1]
        if tag in BLOCKS and not (tag in ("p", "div") and flow.mark and not flow.parts):
            flow.gap() if tag in PARAGRAPHS and not (tag in LISTS and len(self.lists)) else flow.end_line()
        if tag in LISTS:
            start = attributes.get("start", "")
            self.lists.append((int(start) if re.fullmatch("[0-9]{1,9}", start) else 1) if tag == "ol" else None)
            flow.indent += 2 if tag != "ol" else 4
        elif tag == "li" and not hidden:
            number = self.lists[-1] if self.lists else None
            flow.mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
        elif tag == "dd" or tag == "blockquote":
            flow.indent += 4
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.tables.append(Table())
        elif tag == "tr" and not gone:
            self.tables[-1].rows.append([])
        elif tag in CELLS or tag == "caption":
            self.flows.append(Flow())
            if tag in CELLS:
                spans = [attributes.get(n, "1") for n in ("colspan", "rowspan")]
                self.flows[-1].spans = [min(1000, int(n)) if re.fullmatch("[1-9][0-9]{0,5}", n) else 1 for n in spans]

    def end(self, tag: str) -> None:
        if tag == "p" and not self._in_table("p"):
            self.start("p", {})
        if not self._is_open(tag) or tag not in CELLS | SECTIONS | {"tr", "table"} and not self._in_table(tag):
            return
        while self._close() != tag:
            pass

    def text(self, text: str) -> None:
        if text.strip(" \t\n\r\f"):
            self._end_head()
        if not (self.hidden and any(self.hidden[-1])):
            self.flows[-1].write(text, self.pre > 0)

    def finish(self) -> str:
        while self.open:
            self._close()
        return "\n".join(self.flows[0].done())

    def _end_head(self) -> None:
        """The end of a head whose end tag is left out."""
        self.headed = True
        if self.open and self.open[-1] == "head":
            self._close()

    def is_foreign(self) -> bool:
        return any(map(self._is_open, FOREIGN))

    def _is_open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def _nearest(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _in_table(self, tag: str) -> bool:
        """Is such an element open inside the nearest table, or at all where there is none?"""
        return self._nearest({tag}) > self._nearest({"table"})

    def _imply_end(self, tags: set[str], boundary: set[str]) -> None:
        place = self._nearest(tags)
        if place > self._nearest(boundary):
            while len(self.open) > place:
                self._close()

    def _close(self) -> str:
        tag, (gone, unseen) = self.open.pop(), self.hidden.pop()
        hidden = gone or unseen
        self.places[tag].pop()
        if tag in CELLS:
            cell = self.flows.pop()
            lines = cell.done()
            if (lines or not hidden) and self.tables[-1].rows:
                self.tables[-1].rows[-1].append((*cell.spans, lines))
            return tag
        if tag == "caption":
            self.tables[-1].caption = self.flows.pop().done()
            return tag
        flow = self.flows[-1]
        if tag == "table":
            table = self.tables.pop()
            flow.gap()
            if not gone:
                for line in table.lines():
                    flow.parts.append(line)
                    flow.end_line()
            flow.gap()
            return tag
        if tag in BLOCKS:
            flow.gap() if tag in PARAGRAPHS and not (tag in LISTS and len(self.lists) > 1) else flow.end_line()
        if tag in LISTS:
            flow.indent -= 4 if self.lists.pop() is not None else 2
        elif tag == "li":
            flow.mark = ""
        elif tag == "dd" or tag == "blockquote":
            flow.indent -= 4
        elif tag == "pre":
            self.pre -= 1
        return tag


def visible_text(source: str | None) -> str:
    """Text that a browser would show for a page."""
    page, at = Page(), 0
    source = source or ""
    tags = Tags(source)
    while found := tags.next(at):
        start, end, closed, opened, inside = found
        if start > at:
            page.text(html.unescape(source[at:start]))
        at = end
        if closed:
            page.end(closed.lower())
        elif opened:
            tag = opened.lower()
            attributes = {n.lower(): html.unescape(v.strip("\"'")) for n, v in ATTRIBUTE.findall(inside)} if inside.strip() else {}
            empty = inside.endswith("/") and not UNQUOTED_END.search(inside)
            page.start(tag, attributes, empty)
            if tag in RAW and tag not in VOID and not (empty and page.is_foreign()):
                stop, end = tags.raw_end(tag, at)
                if tag == "textarea":
                    page.text(html.unescape(source[at:stop]))
                page.end(tag)
                at = end
    page.text(html.unescape(source[at:]))
    return page.finish()


def extract(pages: DataFrame) -> DataFrame:
    """Visible text of every page: (page_id, text, n_lines).

    Null or empty html: empty text, no lines.  Broken markup is read as browsers read it: unclosed elements end with
    their parent, stray end tags are ignored, an unfinished tag is text.  Null or repeated page_id: one row for each input
    row.  Further columns are ignored.  No rows: no rows.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()
    kinds = [pa.int32() if id_type == "int" else pa.int64(), pa.string(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(s) for s in batch.column(1).to_pylist()]
            columns = [batch.column(0), texts, [t.count("\n") + 1 if t else 0 for t in texts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "text", "n_lines"])

    return pages.select("page_id", "html").mapInArrow(rows, f"page_id {id_type}, text string, n_lines long")
