"""Formulas, drawings, xmp and deeply nested elements: all that is visible, and nothing that is hidden."""

import pytest

from cohortloom.llm.html import MOST_DEPTH, page_text

DEEP = "<div>" * (MOST_DEPTH + 50)


@pytest.mark.parametrize(
    "page, text",
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=t>x=2</annotation></math> b", "a x=2 b"),
        ("<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><metadata>m</metadata><text>one</text><text>two</text></svg>b", "one\ntwo\nb"),
        ("<svg><defs/><rect x=1 /><title/><text>seen</text></svg>b", "seen\nb"),
        ("<svg><style>p{}</style><text><![CDATA[a<b&amp;]]></text></svg>", "a<b&amp;"),
        ("a<svg/>b<desc>c</desc>", "abc"),
        ("<p>a<xmp>x <b>&amp;\n  y</b></xmp>c", "a\n\nx <b>&amp;\n  y</b>\n\nc"),
        ("<xmp hidden>x</xmp>y", "y"),
        (f"<section hidden>{DEEP}<section>x</section>y{'</div>' * (MOST_DEPTH + 50)}z</section>w", "w"),
        (f"{DEEP}a<p hidden>no <b>no</b></p>b<div>c</div>d<span>e</span>f", "ab\nc\ndef"),
        (f"<em>{DEEP}<em>a</em> b{'</div>' * (MOST_DEPTH + 50)} c</em> d", "a b\nc d"),
        (f"<div hidden>{DEEP}x{'</div>' * (MOST_DEPTH + 50)}y</div>z", "z"),
        (f"{DEEP}<span hidden><span>x</span>y</span>z", "z"),
    ],
)
def test_visible(page, text):
    assert page_text(page) == text


def test_deep_pages_in_linear_time():
    assert page_text("<li><ul>" + "<span>" * 50_000 + "<li>x" * 50_000).count("x") == 50_000
    assert page_text("<div><table>" + "<b>" * 50_000 + "</div>" * 50_000 + "x") == "x"
