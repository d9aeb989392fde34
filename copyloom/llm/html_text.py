"""Text of HTML pages by layout-aware rendering.

A tree builder with implied tags follows the open elements; visibility rules leave out what a browser doesn't show;
blocks, lists, preformatted text and tables keep their shape, table cells aligned in columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = set("head script style template noscript title meta link iframe object audio video canvas datalist annotation annotation-xml".split())
#: What head can hold; anything else ends it. Parts of a drawing that are only referred to; the others show the text in text and foreignObject.
_IN_HEAD = set("base basefont bgsound link meta title style script noscript noframes template html head".split())
_FOREIGN, _SVG_TEXT = {"svg", "math"}, {"text", "foreignobject"}
_SVG_HIDDEN = set("defs symbol desc metadata clippath mask marker pattern lineargradient radialgradient filter".split())
_SPACED = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
_BLOCK = _SPACED | set("html body address article aside details dialog dd div dt fieldset figcaption footer form header hgroup legend li main menu nav section summary center tr caption thead tbody tfoot option optgroup".split())
#: An element ends those of the second set that are open, up to one of the third.
_CELL, _ROW = {"td", "th"}, {"td", "th", "tr"}
_GROUPS = {"thead", "tbody", "tfoot"}
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": (_CELL, {"tr", "table"}), "th": (_CELL, {"tr", "table"}),
    "tr": (_ROW, {"table"}), "thead": (_ROW | _GROUPS, {"table"}), "tbody": (_ROW | _GROUPS, {"table"}), "tfoot": (_ROW | _GROUPS, {"table"}),
    "body": ({"head"}, {"html"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
_ENDS_P = _BLOCK - {"html", "body", "li", "dt", "dd", "caption", "legend", "summary", "option", "optgroup"} - _ROW - _GROUPS
_P_SCOPE = {"td", "th", "li", "div", "body", "table", "button"}
#: Columns of a table, columns and rows that a cell covers at most, and characters to which a column is filled up; wider cells push what follows.
COLUMNS, ACROSS, DOWN, FILLED = 1000, 100, 65534, 200
#: Spaces in front of a cell at most; tables in one another whose columns are aligned, as each copies the lines within it (the cells of deeper ones follow one another).
BLANK, DEEP = 400, 16
_TAG, _SPACE = re.compile(r"<[a-zA-Z/!?]"), re.compile(r"\s|!important")


class _Sheet:
    """Lines being written: of the page, or of one table cell. line holds the pieces of the current one."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space = 0, False
        self.mark = ""

    def add(self, text: str, kept: bool) -> None:
        if kept:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.end(0, force=True)
                self.put(part)
            return
        words = text.split(None)
        if not words:
            self.space = self.space or bool(text)
            return
        if self.line and (self.space or text[0].isspace()):
            self.line.append(" ")
        self.put(" ".join(words))
        self.space = text[-1].isspace()

    def put(self, text: str) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            self.gap = 0
            if self.mark:
                self.line, self.mark = [self.mark], ""
        if text:
            self.line.append(text)

    def end(self, margin: int, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
            self.gap = 0
        self.space = False
        self.gap = max(self.gap, margin + 1)

    def text(self) -> list[str]:
        self.end(0)
        return self.lines


def _number(text: str | None, least: int, most: int, none: int) -> int:
    m = re.match(r"\s*([+-]?[0-9]{1,9})", text or "")
    return min(most, max(least, int(m[1]))) if m else none


class _Renderer(HTMLParser):
    """Each open element is (tag, hidden, unseen, closed): it or one above isn't displayed; isn't visible, though an element in it may be;
    is a closed details, of which only the summary shows. at holds the places of open elements by tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.sheets = [_Sheet()]
        self.tables: list[list[list[tuple[list[str], int, int]]]] = []
        self.spans: list[tuple[int, int]] = []
        self.lists: list[list] = []
        self.pre = self.foreign = self.svg = self.flat = 0
        self.fresh = False  # right after <textarea>, where a line feed doesn't count

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted."""
        return j

    def _last(self, tags) -> int:
        """The place of the innermost open element of these tags."""
        last = -1
        for t in tags:
            if (at := self.at.get(t)) and at[-1] > last:
                last = at[-1]
        return last

    def _close(self, k: int) -> None:
        while len(self.open) > k:
            tag, hidden, _, _ = self.open.pop()
            self.at[tag].pop()
            self.foreign -= tag in _FOREIGN
            self.svg -= tag == "svg"
            if hidden:
                continue
            sheet = self.sheets[-1]
            if self.flat and tag in _CELL | {"table"}:
                sheet.end(int(tag == "table"))
                self.flat -= tag == "table"
            elif tag in _CELL and self.tables and len(self.sheets) > 1:
                lines = self.sheets.pop().text()
                if not self.tables[-1]:
                    self.tables[-1].append([])
                self.tables[-1][-1].append(([x for x in lines if x] or [""], *self.spans.pop()))
            elif tag == "table" and self.tables:
                self._table(self.tables.pop())
            elif tag in ("ul", "ol", "menu") and self.lists:
                self.lists.pop()
                sheet.end(int(not self.lists))
            elif tag == "pre":
                self.pre -= 1
                sheet.end(1)
            elif tag == "textarea":
                self.pre -= 1
            elif tag == "text" and self.svg:
                sheet.space = True
            elif tag in _BLOCK:
                sheet.end(int(tag in _SPACED))

    def _table(self, rows: list[list[tuple[list[str], int, int]]]) -> None:
        """Cells stand in the first free columns; those that cover several columns or rows keep them."""
        sheet = self.sheets[-1]
        placed, wide = [], {}
        # Columns that a cell from above covers until some row; of those before `high`, the free ones in order.
        until, due, free, high = {}, defaultdict(list), [], 0
        for r, row in enumerate(r for r in rows if r):
            if back := [c for c in due.pop(r, ()) if until[c] == r]:
                free = sorted([*free, *back])
            col, cells = 0, []
            for lines, across, down in row:
                k = bisect_left(free, col)
                col = free[k] if k < len(free) else max(col, high)
                across = max(1, min(across, COLUMNS - col))
                cells.append((col, across, lines))
                if down > 1:
                    free = [*free, *range(high, col)]
                    high = max(high, col + across)
                    del free[bisect_left(free, col) : bisect_left(free, col + across)]
                    for c in range(col, col + across):
                        until[c] = r + down
                        due[r + down].append(c)
                if across == 1:
                    wide[col] = max(wide.get(col, 0), min(FILLED, max(map(len, lines))))
                col += across
            placed.append(cells)
        for col, across, lines in ((c, a, x) for cells in placed for c, a, x in cells if a > 1):  # the last column takes what they need more
            last, have = col + across - 1, sum(wide[c] + 2 for c in range(col, col + across) if c in wide) - 2
            more = min(FILLED, max(map(len, lines))) - have
            if more > 0:
                wide[last] = wide[last] + more if last in wide else max(0, more - 2)
        sheet.end(1)
        start, upto = [0], 0  # where each column begins
        for c in range(max((c + a for cells in placed for c, a, _ in cells), default=0)):
            upto += wide[c] + 2 if c in wide else 0
            start.append(upto)
        for cells in placed:
            for n in range(max(len(lines) for _, _, lines in cells)):
                line, size = [], 0
                cells = [x for x in cells if len(x[2]) > n]
                for col, _, lines in cells:
                    if text := lines[n]:
                        fill = min(BLANK, max(start[col] - size, 2 if size else 0))
                        line.append(" " * fill + text)
                        size += fill + len(text)
                if line:
                    sheet.put("".join(line))
                    sheet.end(0)
        sheet.end(1)

    def handle_starttag(self, tag: str, attrs) -> None:
        self.fresh = False
        if self.open and self.open[-1][0] == "head":
            if tag in ("html", "head"):
                return
            if tag not in _IN_HEAD:
                self._close(len(self.open) - 1)
        elif tag == "head" and any(x[0] != "html" for x in self.open[-2:]):
            return
        if tag in _ENDS:
            ended, limit = _ENDS[tag]
            while (k := self._last(ended)) > self._last(limit):
                self._close(k)
                if tag not in _GROUPS and tag != "tr":
                    break
        if self.at["p"] and tag in _ENDS_P and self.at["p"][-1] > self._last(_P_SCOPE):
            self._close(self.at["p"][-1])
        a = {k: v or "" for k, v in reversed(attrs)}  # the first of a name counts
        _, hidden, unseen, closed = self.open[-1] if self.open else ("", False, False, False)
        hidden = hidden or closed and tag != "summary" or tag in _HIDDEN or bool(self.svg) and tag in _SVG_HIDDEN or "hidden" in a or tag == "dialog" and "open" not in a
        if "style" in a:
            style = dict(x.split(":", 1) for x in _SPACE.sub("", a["style"].lower()).split(";") if ":" in x)
            hidden = hidden or style.get("display") == "none"
            if "visibility" in style:
                unseen = style["visibility"] in ("hidden", "collapse")
        sheet = self.sheets[-1]
        if tag in _VOID:
            if not hidden:
                if tag == "br":
                    sheet.end(0, force=not sheet.line and bool(sheet.lines) and sheet.gap == 1)
                elif tag == "hr":
                    sheet.end(1)
                elif tag == "input" and not unseen and a.get("type", "").lower() in ("submit", "button", "reset") and a.get("value"):
                    sheet.add(a["value"], False)
            return
        self.at[tag].append(len(self.open))
        self.open.append((tag, hidden, unseen, tag == "details" and "open" not in a))
        self.foreign += tag in _FOREIGN
        self.svg += tag == "svg"
        if hidden:
            return
        if tag == "table" and len(self.tables) >= DEEP:
            sheet.end(1)
            self.flat += 1
        elif self.flat and tag in _CELL | {"tr"}:
            sheet.end(0)
        elif tag == "table":
            sheet.end(1)
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in _CELL and self.tables:
            self.sheets.append(_Sheet())
            self.spans.append((_number(a.get("colspan"), 1, ACROSS, 1), _number(a.get("rowspan"), 1, DOWN, 1)))
        elif tag in ("ul", "ol", "menu"):
            sheet.end(int(not self.lists))
            self.lists.append([tag, _number(a.get("start"), -(10**9), 10**9, 1), -1 if "reversed" in a and "start" in a else 1])
        elif tag == "li":
            sheet.end(0)
            mark = "* "
            if self.lists and self.lists[-1][0] == "ol":
                self.lists[-1][1] = _number(a.get("value"), -(10**9), 10**9, self.lists[-1][1])
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += self.lists[-1][2]
            sheet.mark = "" if unseen else "  " * min(40, len(self.lists) - 1) + mark
        elif tag == "pre":
            sheet.end(1)
            self.pre += 1
        elif tag == "textarea":
            if sheet.line and sheet.space:
                sheet.line.append(" ")
            sheet.space, self.fresh = False, True
            self.pre += 1
        elif tag == "text" and self.svg:
            sheet.space = True
        elif tag in _BLOCK:
            sheet.end(int(tag in _SPACED))
            if tag == "optgroup" and a.get("label") and not unseen:
                sheet.add(a["label"], False)
                sheet.end(0)

    def handle_startendtag(self, tag: str, attrs) -> None:
        """In svg and math, and for these themselves, the slash closes; elsewhere browsers ignore it."""
        inside = self.foreign
        self.handle_starttag(tag, attrs)
        if (inside or tag in _FOREIGN) and self.open and self.open[-1][0] == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.at["p"]:
            self.handle_starttag("p", [])  # an end alone is an empty paragraph
        if tag == "br":
            self.handle_starttag("br", [])
        k = self.at[tag][-1] if self.at[tag] else -1
        if k >= 0 and (tag in _GROUPS or tag in _CELL or tag in ("tr", "table", "body", "html") or k > self._last(_CELL)):
            self._close(k)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._close(len(self.open) - 1)
        if self.fresh:
            data, self.fresh = data.removeprefix("\r").removeprefix("\n"), False
        if self.open and (self.open[-1][1] or self.open[-1][2] or self.open[-1][3]) or self.svg and self._last(("svg",)) > self._last(_SVG_TEXT):
            return
        self.sheets[-1].add(data, self.pre > 0)

    def result(self) -> str:
        self._close(0)
        return "\n".join(self.sheets[0].text()).strip("\n")


def render(html: str | None) -> str:
    """The visible text of a page; an empty string for null, empty or invisible ones. What follows a tag or comment that never ends is dropped."""
    if not html:
        return ""
    last = html.rfind(">") + 1
    if cut := _TAG.search(html, last):
        html = html[: cut.start()]
    page = _Renderer()
    page.feed(html)
    page.close()
    return page.result()


def html_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages, of whole pages of any length and depth.

    Null or empty pages have an empty text; repeated rows give the same text each; broken markup is read as browsers do where
    the rules above say, else tag by tag. An empty table gives an empty one; other columns are ignored.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = [render(x) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
