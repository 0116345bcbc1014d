"""Whole pages: random trees against what they show, hostile pages, DataFrame edge rows."""

import random
import time

import pytest

from tidewire.llm import html_text
from tidewire.llm.html_text import page_text

INLINE, BLOCKS = ("b", "i", "span", "a", "em"), ("div", "p", "section", "ul", "table", "blockquote", "h2", "pre")


class Page:
    """A random page and the words that it shows, in order, by a plain recursive rule."""

    def __init__(self, seed):
        self.r, self.n, self.seen = random.Random(seed), 0, []
        self.html = self.blocks(4, True)

    def word(self, shown):
        self.n += 1
        if shown:
            self.seen.append(f"w{self.n}")
        return f"w{self.n}" if self.r.random() < 0.8 else f"w{self.n} &nbsp;<!-- n{self.n} -->"

    def style(self, shown, visible):
        """(attributes, shown, visible) of a child."""
        k = self.r.random()
        if k < 0.06:
            return self.r.choice([" hidden", ' style="display: none"', ' style="color:red;DISPLAY:none"']), False, False
        if k < 0.12:
            return ' style="visibility:hidden"', shown, False
        if k < 0.18:
            return " style='visibility: visible'", shown, True
        return self.r.choice(["", ' class="hidden"', ' title="display:none"', ' data-x="a > b"']), shown, visible

    def inline(self, depth, shown, visible=True):
        out = []
        for _ in range(self.r.randint(1, 3)):
            if depth and self.r.random() < 0.4:
                tag, (attrs, s, v) = self.r.choice(INLINE), self.style(shown, visible)
                out.append(f"<{tag}{attrs}>{self.inline(depth - 1, s, v)}</{tag}>")
            else:
                out.append(self.word(shown and visible))
        return " ".join(out)

    def blocks(self, depth, shown, visible=True):
        out = []
        for _ in range(self.r.randint(1, 3)):
            if not depth or self.r.random() < 0.2:
                out.append(f"<div>{self.inline(2, shown, visible)}</div>")
                continue
            tag, (attrs, s, v) = self.r.choice(BLOCKS), self.style(shown, visible)
            if tag == "ul":
                inner = "".join(f"<li>{self.blocks(depth - 1, s, v)}" for _ in range(self.r.randint(1, 3)))
            elif tag == "table":
                inner = "".join("<tr>" + "".join(f"<td>{self.inline(1, s, v)}" for _ in range(self.r.randint(1, 3))) for _ in range(self.r.randint(1, 3)))
            elif tag in ("p", "h2", "pre"):
                inner = self.inline(2, s, v)
            else:
                inner = self.blocks(depth - 1, s, v)
            out.append(f"<{tag}{attrs}>{inner}</{tag}>")
            if self.r.random() < 0.2:
                out.append("<script>if (a<b) { '</div>' }</script><style>p{}</style>")
        return "".join(out)


@pytest.mark.parametrize("seed", range(60))
def test_random_pages_show_their_visible_words(seed):
    page = Page(seed)
    words = [w for w in page_text(page.html).split() if w not in ("-", "\xa0")]
    assert words == page.seen


def test_visible_parts_of_hidden_elements():
    assert page_text('<div style="visibility:hidden">no<p style="visibility:visible">yes</p>no</div>after') == "yes\n\nafter"
    assert page_text('<div hidden>no<p style="visibility:visible">no</p></div>after') == "after"


def test_depth_keeps_text_and_marks():
    deep = page_text("<ul><li>" * 40 + "x" + "<table><tr><td>a<td>b<tr><td>c<td>d</table>")
    assert deep.split().count("-") == 40 and [w for w in deep.split() if w != "-"] == ["x", "a", "b", "c", "d"]
    assert page_text("<div>" * 5000 + "x<p hidden>no</p>y") == "xy"


def test_elements_beyond_the_depth_part_lines_and_words():
    deep = "<div>" * 600
    assert page_text(deep + "<ul><li>z</ul>tail").split() == ["z", "tail"]
    assert page_text(deep + "<p>a</p>b<section>c</section>d").split() == ["a", "b", "c", "d"]
    assert page_text(deep + "<table><tr><td>a<td>b<tr><td>c</table>d").split() == ["a", "b", "c", "d"]
    assert page_text(deep + "a<b>b</b>c" + "</div>" * 600 + "<b>x</b>y").split() == ["abc", "xy"]


def test_drawings_formulas_and_maps_are_visible():
    page = "<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>drawn</text></svg> <math><mi>x</mi><annotation>no</annotation></math> <map>way<area></map><desc>seen</desc>"
    assert page_text(page) == "drawn x wayseen"


def test_wide_cells_do_not_multiply():
    page = "<table><tr><td>" + "w" * 60_000 + "<td>z" + "<tr><td>a<td>b" * 4_000
    out = page_text(page)
    assert len(out) < 1_000_000 and out.count("b") == 4_000 and "w" * 60_000 + "  z" in out
    rows = [[(f"{i}", 1, 1), ("x" * (i % 5), 1, 1), ("end", 1, 1)] for i in range(12)]
    at = {line.index("end") for line in html_text.align(rows).split("\n")}
    assert len(at) == 1


N = 300_000
HOSTILE = {
    "quotes": '<a b="' * (N // 6) + ">x", "half quotes": "<a b='>' " * (N // 9) + '"x', "lists": "<ul><li>x" * (N // 9), "open": "<" * N, "names": "<a " * (N // 3),
    "script": "<script>" + "</script " * (N // 9), "comments": "<!--" * (N // 4), "tables": "<table><tr><td>x" * (N // 16), "style": '<p style="' + "display:((" * (N // 10) + '">x',
    "spans": "<table>" + "<td rowspan=999>x" * (N // 40) + "<tr><td>y" * (N // 20), "ends": "<i><button>" + "<b>" * (N // 8) + "</i>" * (N // 8), "depth": "<div>" * (N // 5),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_time_and_room_in_proportion(name):
    began = time.process_time()
    assert len(page_text(HOSTILE[name])) < 10 * N
    assert time.process_time() - began < 15


def test_frame(spark):
    rows = [(1, "u", "<p>a", 7), (1, "u", "<p>a", 7), (2, None, None, 7), (3, "u", "", 7), (None, "u", "<b>x</b>" * 30_000, 7), (4, "u", "<p hidden>x", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, html_text.extract_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "a", 1, 1), (1, "u", "a", 1, 1), (2, None, "", 0, 0), (3, "u", "", 0, 0), (None, "u", "x" * 30_000, 30_000, 1), (4, "u", "", 0, 0)], key=str)
    assert html_text.extract_text(pages.limit(0)).count() == 0
