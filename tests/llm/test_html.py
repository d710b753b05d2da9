import re

import pytest

from cohortloom.llm.html import extract_text, page_text

CASES = [
    ("", ""),
    ("plain", "plain"),
    ("<p>a<p>b", "a\n\nb"),
    ("<p>a  \n b<br>c</p>d", "a b\nc\n\nd"),
    ("a<b>b</b>c <i> d</i> e", "abc d e"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<li>b<br>c</ol>", "9. a\n10. b\n    c"),
    ("<table><tr><th>name<th>n<tr><td>ab<td>1<tr><td>longer<td>22</table>", "name    n\nab      1\nlonger  22"),
    ("<table><caption>T</caption><tr><td>x<td hidden>y<td>z</table>after", "T\nx  z\n\nafter"),
    ("a<script>if (a<b) '</p>'</script>b<style>p{}</style><!-- c > --><template>d</template>e", "abe"),
    ("<head><title>t</title></head><body>b", "b"),
    ("<p style='display: none'>x</p><p hidden>y</p><span aria-hidden=true>z</span>w", "w"),
    ("<pre>a\n  b\n\nc</pre>", "a\n  b\n\nc"),
    ("1 &lt; 2 &amp; 3 &middot; &copy;", "1 < 2 & 3 · ©"),
    ("x < y and <3", "x < y and <3"),
    ("<p title='a>b'>c</p>", "c"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"),
    ("</div></p>a</b>", "a"),
    ("<!DOCTYPE html><html><body>ü🙂<hr>b</body></html>", "ü🙂\n\nb"),
    ("<a href=x>l</a><img alt=i><input type=text value=v>m", "lm"),
    ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
    ("<script>never closed", ""),
    ("<p", "<p"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_layout(page, text):
    assert page_text(page) == text


def test_hostile_pages():
    assert page_text("<div>" * 50_000 + "x") == "x"
    assert page_text("<" * 3_000) == "<" * 3_000
    assert page_text("<ul><li>" * 5_000 + "deep").endswith("deep")
    assert len(page_text("<td>w " * 20_000)) >= 20_000


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r.text for r in extract_text(pages).collect()}
    for p in pages.collect():
        text = rows[p.page_id]
        # The words of every paragraph are there, in order; nothing of scripts and styles is.
        assert "track(" not in text and "margin:0" not in text
        for paragraph in re.findall(r"<p>([^<&]*)</p>", p.html):
            assert " ".join(paragraph.split()) in text


def test_null_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "<p>x", "a"), (None, "", None)], "page_id long, html string, text string")
    assert sorted(((r.page_id, r.text) for r in extract_text(df).collect()), key=str) == [(1, "x"), (1, None), (None, "")]
    assert extract_text(df.limit(0)).count() == 0
