"""Visible text of HTML pages, laid out as a reader would see it.

A tree builder reads any markup: it opens and closes what the markup leaves out (html, head, body, p, li, dt, dd,
option, tbody, tr, td), keeps script and style bodies out of the text, and ignores stray end tags. Rendering walks the
tree with its own stack: blocks start lines, paragraphs and headings stand apart by an empty line, list items carry
bullets or numbers and hang, table cells align in columns, pre keeps its white space. Hidden are elements with the
hidden attribute or display:none, those with visibility:hidden but for parts that are set visible again, form inputs,
closed details but their summary, head, script, style, template, noscript, iframe, object and their like, and what a
drawing defines but does not draw. All other text comes out whole, that of drawings, formulas and maps, too.

Time and output stay in proportion to the page, whatever the markup: tags are read in one pass, elements nested deeper
than MOST_DEPTH become siblings whose ends still part lines and words, indents end at MOST_FRAMES levels (marks and cells stay), and table cells are padded
up to column WIDEST_LINE only. None of these bounds drops text.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
INVISIBLE = frozenset(
    "head script style template noscript iframe object embed audio video canvas datalist input select textarea noembed noframes title param source track area annotation annotation-xml".split()
)
#: Parts of a drawing that are not drawn; elsewhere their names mean nothing.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern".split())
#: Elements that begin and end on lines of their own, and those of them that stand apart by an empty line.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul tr caption thead tbody tfoot".split()
)
APART = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of these ends an open p.
ENDS_P = (BLOCK - frozenset("li dd dt option optgroup tr caption thead tbody tfoot html body legend".split())) | {"li", "dd", "dt"}
#: What a start tag closes, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("table td th caption html template button object".split())
#: Lists, quotes and tables nested deeper than this keep their marks and cells, but get no further indent or columns.
MOST_FRAMES = 12
#: Open elements; a start tag beyond them opens nothing, as in browsers.
MOST_DEPTH = 512
#: A column counts cells up to this width, cells are padded up to this column, and so many columns heed row spans.
WIDEST_CELL, WIDEST_LINE, MOST_COLUMNS = 100, 240, 1000

#: A tag without angle brackets in its attributes: all but a few. Others are walked quote by quote.
_PLAIN_TAG = re.compile(r"<(?:/([a-zA-Z][^\s/<>]*+)[^<>]*+|([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+))>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_UNQUOTED = re.compile(r"[^>\"']*+")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"(?:[^;\"'(]++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|\([^)]*+(?:\)|\Z))++")
_DIGITS = re.compile(r"\s*(\d{1,3})")
_END_OF: dict[str, re.Pattern] = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}


def attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name, the first of each; a bare attribute has an empty one."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = m[2] or m[3] or m[4] or ""
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return found


def shown(attrs: dict[str, str]) -> str:
    """What the attribute hidden and the style say: "none", "hidden", "visible", or nothing ("")."""
    if "hidden" in attrs:
        return "none"
    style = attrs.get("style", "").lower()
    if "display" not in style and "visibility" not in style:
        return ""
    set_to: dict[str, tuple[bool, str]] = {}
    for declaration in _DECLARATION.findall(_COMMENT.sub(" ", style)):
        name, _, value = declaration.partition(":")
        value, mark, _ = value.partition("!")
        name, strong = name.strip(), bool(mark)
        if strong or not set_to.get(name, (False, ""))[0]:
            set_to[name] = (strong, value.strip())
    if set_to.get("display", (False, ""))[1] == "none":
        return "none"
    return {"hidden": "hidden", "collapse": "hidden", "visible": "visible"}.get(set_to.get("visibility", (False, ""))[1], "")


class Tags:
    """The tags of a page, in one pass: `next` gives (start, end, end tag or None, start tag or None, attributes)."""

    def __init__(self, markup: str):
        self.markup, self.last = markup, markup.rfind(">")
        self.lost: set[int] = set()  # places outside quotes from which no tag ends

    def next(self, at: int) -> tuple[int, int, str | None, str | None, str] | None:
        markup = self.markup
        while 0 <= (at := markup.find("<", at)):
            if m := _PLAIN_TAG.match(markup, at):
                return at, m.end(), m[1], m[2], m[3] or ""
            if markup.startswith("<!--", at):
                end = markup.find("-->", at + 4)
                return at, len(markup) if end < 0 else end + 3, None, None, ""
            if at > self.last:
                return None  # no tag ends any more
            after = markup[at + 1 : at + 2]
            if after in ("!", "?"):
                return at, markup.index(">", at) + 1, None, None, ""
            if after == "/" and (m := _NAME.match(markup, at + 2)):
                return at, markup.index(">", m.end()) + 1, m[0], None, ""
            if m := _NAME.match(markup, at + 1):
                end = self.tag_end(m.end())
                return at, end + 1, None, m[0], markup[m.end() : end]
            at += 1
        return None

    def tag_end(self, at: int) -> int:
        """Place of the > outside quotes that ends a tag, or of the next one where quotes never close."""
        markup, passed, here = self.markup, [], at
        while here not in self.lost:
            passed.append(here)
            here = _UNQUOTED.match(markup, here).end()
            if here >= len(markup):
                break
            if markup[here] == ">":
                return here
            closing = markup.find(markup[here], here + 1)
            if closing < 0:
                break
            here = closing + 1
        self.lost.update(passed)
        return markup.index(">", at)


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attributes(attrs), []


class TreeBuilder:
    """Builds a tree whose root is html, with head where given and body always."""

    def __init__(self) -> None:
        self.root, self.body = Node("html"), Node("body")
        self.root.kids.append(self.body)
        self.open = [self.root, self.body]
        self.count = Counter()  # open elements by tag, below body
        self.flat = Counter()  # elements beyond MOST_DEPTH that have not ended, by tag

    def build(self, markup: str) -> Node:
        at, head, tags = 0, False, Tags(markup)
        while at < len(markup):
            found = tags.next(at)
            start, after, end, tag, attrs = found or (len(markup), len(markup), None, None, "")
            if text := markup[at:start]:
                if head and not text.isspace():
                    self.close_to("head")
                    head = False
                self.text(text)
            at, tag = after, (tag or "").lower()
            if end:
                if end.lower() == "head":
                    head = False
                self.end(end.lower())
            elif tag in ("html", "body"):
                if head and tag == "body":
                    self.close_to("head")
                    head = False
                node = self.root if tag == "html" else self.body
                node.attrs = node.attrs or attributes(attrs)
            elif tag:
                if tag == "head":
                    head = True
                elif head and tag not in HEAD_ONLY:
                    self.close_to("head")
                    head = False
                self.start(tag, attrs)
                if tag in RAW:
                    stop = _END_OF[tag].search(markup, at)
                    self.open[-1].kids.append(markup[at : stop.start() if stop else len(markup)])
                    closing = markup.find(">", stop.end()) if stop else -1
                    at = closing + 1 if closing >= 0 else len(markup)
                    self.cut(len(self.open) - 1)
        return self.root

    def text(self, text: str) -> None:
        self.open[-1].kids.append(html.unescape(text) if "&" in text else text)

    def start(self, tag: str, attrs: str) -> None:
        if tag in ENDS_P:
            self.close({"p"}, SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        if tag in CLOSES:
            what, stop = CLOSES[tag]
            self.close(what, stop)
        here = self.open[-1].tag
        if tag == "tr" and here == "table":
            self.push("tbody", "")
        elif tag in ("td", "th") and here in ("table", "tbody", "thead", "tfoot"):
            if here == "table":
                self.push("tbody", "")
            self.push("tr", "")
        if tag in UNDRAWN and self.count["svg"]:
            tag = "template"
        node = Node(tag, attrs)
        self.open[-1].kids.append(node)
        if tag in VOID:
            return
        if len(self.open) < MOST_DEPTH or tag in RAW or tag in INVISIBLE or shown(node.attrs) in ("none", "hidden"):
            self.open.append(node)
            self.count[tag] += 1
        else:
            self.flat[tag] += 1
            if tag in ("td", "th"):
                self.open[-1].kids.append(" ")

    def push(self, tag: str, attrs: str) -> None:
        node = Node(tag, attrs)
        self.open[-1].kids.append(node)
        self.open.append(node)
        self.count[tag] += 1

    def cut(self, at: int) -> None:
        """Closes the open elements from `at` on."""
        for node in self.open[at:]:
            self.count[node.tag] -= 1
        del self.open[at:]
        if self.flat and len(self.open) < MOST_DEPTH:
            self.flat.clear()

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in UNDRAWN and self.count["svg"]:
            tag = "template"
        if self.flat[tag] > 0:
            self.flat[tag] -= 1
            if tag in BLOCK:
                self.open[-1].kids.append(Node("div"))
        elif tag == "br":
            self.start("br", "")
        elif tag == "p" and not self.within({"p"}, SCOPE):
            self.open[-1].kids.append(Node("p"))
        elif tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "object"):
            self.close({tag}, frozenset({"html"}) if tag == "table" else frozenset({"table", "html"}))
        else:
            self.close({tag}, SCOPE)

    def within(self, what, stop) -> int:
        """Place of the outermost open element of `what` above the nearest of `stop`; 0 if there is none."""
        found = 0
        if not any(self.count[t] for t in what):
            return 0
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in what:
                found = i
                if len(what) == 1:
                    break
            elif self.open[i].tag in stop:
                break
        return found

    def close(self, what, stop) -> None:
        if at := self.within(what, stop):
            self.cut(at)

    def close_to(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                self.cut(i)
                return


class Flow:
    """Lines of one frame: the page, a list item, a quote or a cell."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap, self.space, self.bare = 0, False, True

    def text(self, text: str) -> None:
        tokens = text.split()
        if not tokens:
            self.space = self.space or bool(text)
            return
        self.begin(" " if self.space or text[0].isspace() else "")
        self.parts.append(" ".join(tokens))
        self.space = text[-1].isspace()

    def begin(self, glue: str) -> None:
        if self.parts:
            if self.gap:
                self.parts.append("\n" * self.gap)
            elif glue and not self.bare:
                self.parts.append(glue)
        self.gap, self.space, self.bare = 0, False, False

    def exact(self, text: str) -> None:
        if text:
            self.begin("")
            self.parts.append(text)

    def line(self, lines: int = 1) -> None:
        """At least so many line ends before what follows."""
        self.gap = max(self.gap, lines) if self.parts else 0
        self.space = False

    def end_line(self) -> None:
        """One more line end (br)."""
        if self.parts:
            self.gap += 1
        self.space = False

    def done(self) -> str:
        return "".join(self.parts)


def _number(attrs: dict[str, str], name: str, default: int) -> int:
    m = _DIGITS.match(attrs.get(name, ""))
    return int(m[1]) if m else default


def _hang(text: str, mark: str) -> str:
    return mark + text.replace("\n", "\n" + " " * len(mark))


def align(rows: list[list[tuple[str, int, int]]]) -> str:
    """Rows of (text, colspan, rowspan) as lines with columns of equal width, two spaces apart.

    Cells wider than WIDEST_CELL run over; what would begin beyond WIDEST_LINE follows two spaces after its left cell.
    """
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    width: dict[int, int] = {}
    for row in rows:
        cells, at = {}, 0
        below = {c: n - 1 for c, n in taken.items() if n > 1}
        for text, across, down in row:
            while taken.get(at, 0) > 0:
                at += 1
            lines = cells[at] = text.split("\n")
            width[at] = max(width.get(at, 0), min(WIDEST_CELL, max(map(len, lines))))
            across = max(1, across)
            if down > 1 and at < MOST_COLUMNS:
                below.update(dict.fromkeys(range(at, min(at + across, MOST_COLUMNS)), down - 1))
            at += across
        grid.append(cells)
        taken = below
    begin, here = {}, 0
    for c in sorted(width):
        begin[c] = here
        here += width[c] + 2
    out = []
    for cells in grid:
        order = sorted(cells)
        for i in range(max((len(x) for x in cells.values()), default=0)):
            line, free = "", True
            for c in order:
                if i < len(cells[c]):
                    if not free or begin[c]:
                        line = (line + "  " if line else "") if begin[c] > WIDEST_LINE else line.ljust(begin[c] - 2) + "  " if line else " " * begin[c]
                    line, free = line + cells[c][i], False
            out.append(line.rstrip())
    return "\n".join(out)


class Renderer:
    """Walks a tree and writes its visible text."""

    def render(self, root: Node) -> str:
        self.flows = [Flow()]
        self.lists: list[list] = []  # [ordered, next number]
        self.tables: list[list] = []  # rows of the open tables
        self.pre, self.mute = 0, False  # mute: inside visibility:hidden
        todo: list[tuple] = [(self.enter, root)]
        while todo:
            act, what = todo.pop()
            if act is None:
                what()
            elif isinstance(what, str):
                if not self.mute:
                    (self.flows[-1].exact if self.pre else self.flows[-1].text)(what)
            else:
                style = shown(what.attrs) if what.attrs else ""
                if style == "none" or what.tag in INVISIBLE:
                    continue
                if style and self.mute != (style == "hidden"):
                    todo.append((None, functools.partial(setattr, self, "mute", self.mute)))
                    self.mute = style == "hidden"
                kids, leave = act(what)
                if leave:
                    todo.append((None, leave))
                todo.extend((self.enter, k) for k in reversed(kids))
        lines = [x.rstrip() for x in self.flows[0].done().split("\n")]
        return "\n".join(lines).strip("\n")

    def enter(self, node: Node):
        tag, flow = node.tag, self.flows[-1]
        if tag == "br":
            flow.end_line()
            return (), None
        if tag == "hr":
            flow.line(2)
            return (), None
        if tag == "img":
            return (), None
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in node.kids if isinstance(k, Node) and k.tag == "summary"][:1]
            flow.line()
            return kids, self.flows[-1].line
        framed = len(self.flows) <= MOST_FRAMES
        if tag in ("ul", "ol", "menu"):
            self.lists.append([tag == "ol", _number(node.attrs, "start", 1)])
            nested = len(self.lists) > 1
            flow.line(1 if nested else 2)
            return node.kids, lambda: (self.lists.pop(), self.flows[-1].line(1 if nested else 2))
        if tag == "li":
            ordered, number = self.lists[-1] if self.lists else (False, 0)
            if ordered:
                number = _number(node.attrs, "value", number)
                self.lists[-1][1] = number + 1
            mark = f"{number}. " if ordered else "- "
            if framed:
                return self.frame(node, lambda text: _hang(text, mark))
            flow.line()
            if not self.mute:
                flow.exact(mark)
                flow.bare = True
            return node.kids, lambda: self.flows[-1].line()
        if tag == "blockquote" and framed:
            return self.frame(node, lambda text: _hang(text, "  "), 2)
        if tag == "dd" and framed:
            return self.frame(node, lambda text: _hang(text, "  "))
        if tag == "table" and framed:
            self.tables.append([])
            flow.line(2)
            self.flows.append(Flow())  # captions and stray text go before the rows
            return node.kids, self.leave_table
        if tag == "tr" and self.tables and framed:
            self.tables[-1].append([])
            return node.kids, None
        if tag in ("td", "th") and self.tables and self.tables[-1] and framed:
            self.flows.append(Flow())
            row = self.tables[-1][-1]
            across, down = _number(node.attrs, "colspan", 1), _number(node.attrs, "rowspan", 1)
            return node.kids, lambda: row.append((self.flows.pop().done(), across, down))
        if tag == "pre":
            flow.line(2)
            self.pre += 1
            return node.kids, self.leave_pre
        if tag in BLOCK:
            apart = 2 if tag in APART else 1
            flow.line(apart)
            return node.kids, lambda: self.flows[-1].line(apart)
        if tag in ("td", "th"):
            flow.space = True
            return node.kids, functools.partial(setattr, flow, "space", True)
        return node.kids, None

    def frame(self, node: Node, shape, apart: int = 1):
        self.flows[-1].line(apart)
        self.flows.append(Flow())

        def leave() -> None:
            text = self.flows.pop().done()
            if text:
                self.flows[-1].exact(shape(text))
            self.flows[-1].line(apart)

        return node.kids, leave

    def leave_table(self) -> None:
        before, rows = self.flows.pop().done(), self.tables.pop()
        flow = self.flows[-1]
        flow.exact(before)
        flow.line()
        flow.exact(align(rows))
        flow.line(2)

    def leave_pre(self) -> None:
        self.pre -= 1
        self.flows[-1].line(2)


def page_text(markup: str) -> str:
    """Visible text of a page; empty for none."""
    return Renderer().render(TreeBuilder().build(markup)) if markup else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars, n_lines.

    Null html counts as empty and gives an empty text of 0 lines; broken markup never fails; repeated rows give
    repeated results; an empty table gives an empty result. Columns other than page_id, url and html are ignored.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [page_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_lines"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long, n_lines long")
