"""Boxes without their end tag don't take the rest of a page, and math is text."""

import pytest

from cartolake.llm import html


def texts(page):
    return [t for t, _ in html.blocks(page)]


@pytest.mark.parametrize("name", "button select svg object video audio canvas noscript template".split())
def test_unclosed_box_ends_at_the_next_block(name):
    assert texts(f"<p>One <{name} x=1>label</p><p>Two</p><div>Three</div>") == ["One", "Two", "Three"]
    assert texts(f"<p>One <{name}>label<p>Two</p><p>Three <{name}>label</{name}> on</p>") == ["One", "Two", "Three on"]
    assert texts(f"<p>One</p><{name}><div>in <{name}>it</{name}></div> still</{name}><p>Two</p>") == ["One", "Two"]


def test_math_is_kept_and_raw_text_is_not():
    assert texts("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>Two<math>y</p><p>End") == ["So x=2 holds", "Twoy", "End"]
    assert texts("<p>One<script>var a = '</p><p>'") == ["One"]
