"""Attributes decide by name what a page shows, never by words inside the values of others."""

import pytest

from tidewire.llm.html_text import page_text


@pytest.mark.parametrize(
    "attrs",
    ['title="the hidden cost of rent"', "aria-label='hidden fees'", 'class="card hidden wide"', 'data-css="display: none"', 'title="visibility:hidden"', 'style="display:none; display:block"', 'style="--display: none"', "data-hidden"],
)
def test_shown(attrs):
    assert page_text(f"<p {attrs}>rent</p>") == "rent"


@pytest.mark.parametrize(
    "attrs",
    ["hidden", 'HIDDEN=""', "class=a hidden", 'title="x"hidden', "style='color:red;display : none'", "style=display:none", 'style="visibility: hidden !important"', 'style="DISPLAY:NONE/* x */"', 'style="display&#58;none"'],
)
def test_hidden(attrs):
    assert page_text(f"<p {attrs}>rent</p>") == ""


def test_other_attributes():
    assert page_text('<details title="now open today"><summary>s</summary>body</details>') == "s"
    assert page_text("<details open><summary>s</summary>body</details>") == "s\nbody"
    assert page_text('<ol title="a start=7"><li>x</ol>') == "1. x"
    assert page_text('<ol start="7"><li>x</ol>') == "7. x"
