import time

import pytest

from tesselar.llm.html_text import extract_text, text_of


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two<div>three</div>", "one\n\ntwo\n\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n\n  - c"),
        ("<ol start=3><li>x</li><li>y</li></ol>z", "3. x\n4. y\n\nz"),
        ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name       n\nlong name  1"),
        ("<p>a <b>b</b>\n c<br>d</p>", "a b c\nd"),
        ("<div hidden>x</div><div style='display: none'>y</div>z", "z"),
        ("<style>.no, #off{display:none}</style><i class='a no'>x</i><i id=off>y</i>z", "z"),
        ("<script>if (a < b) document.write('<p>x</p>')</script>ok<!-- <p>no -->", "ok"),
        ("<title>t</title><body>x", "x"),
        ("<pre>a  b\n  c</pre>", "a  b\n  c"),
        ("</div></p>x<b>y", "x\ny".replace("\n", "")),
        ("a<div>b</div>c", "a\nb\nc"),
        ("<p>x<", "x<"),
        ("<" * 3 + "div" + ">" + "q", "<<\nq"),
    ],
)
def test_layout(source, text):
    assert text_of(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<style>@media print {nav, .side {display:none}} @media (max-width: 9em) {p {display:none}}</style><nav>a</nav><p class=side>b", "a\n\nb"),
        ("<style>@media screen {.x {display:none}} @import url(a); .y {display:none}</style><i class=x>a</i><i class=y>b</i>c", "c"),
        ("<style>.x {display:none} .x {display:block}</style><i class=x>a</i>", "a"),
        ("<style>.x {display:none !important} .x {display:block}</style><i class=x>a</i>b", "b"),
        ("<style>.x {display:none}</style>" + "<div>" * 200 + "<p class=x>a<p>b", "b"),
        ("<style>/* } */ .x {color:red; display:none}</style><i class=x>a</i>b", "b"),
        ("<table><tbody><td>x<td>y</table>", "x  y"),
        ("<table><td>x<td>y<tr><td>z</table>", "x  y\nz"),
        ("<table>one<tbody>two<tr>three<td>x</table>", "onetwothree\nx"),
        ("<math><mi>a</mi><mo>+</mo></math> <svg><text>b</text></svg>", "a+ b"),
        ("x<select><option>a<option>b</select><textarea>c &amp; d</textarea>", "x a b c & d"),
        ("<div>" * 200 + "<p hidden>a</p><script>b</script><i style='display:none'>c<b>d</b></i>e", "e"),
    ],
)
def test_all_visible_text(source, text):
    assert text_of(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b>c</div>d", "b\nd"),
        ("<style>.x{display:none}</style><p class=x style='display:block'>a<p class=x>b", "a"),
        ("<style>.x{display:none !important}</style><p class=x style='display:block'>a<p>b", "b"),
        ("<style media=print>p{display:none}</style><p>a", "a"),
        ("<style media='screen, print'>p{display:none}</style><p>a</p>b", "b"),
        ("<style>div.no{display:none}</style><div class=no>a</div><p class=no>b", "b"),
        ("<style>.a .b{display:none}</style><div class=a><i><i class=b>x</i></i>y</div><i class=b>z</i>", "y\nz"),
        ("<style>.a > .b{display:none}</style><div class=a><i><i class=b>x</i></i><i class=b>y</i></div>", "x"),
        ("<style>.a > .m .b{display:none}</style><div class=a><div class=m><div class=m><i class=b>x</i></div></div>y</div>", "y"),
        ("<style>#i{display:block} .x{display:none}</style><p id=i class=x>a<p class=x>b", "a"),
        ("<style>[data-x=off]{display:none} p:hover{display:none}</style><p data-x=off>a<p data-x=on>b", "b"),
        ("<style>[hidden]{display:block}</style><p hidden>a", "a"),
        ("<details><summary>s</summary>a<p>b</details><details open><summary>t</summary>c</details>", "s\nt\nc"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>b<td>c<tr><td>d<td>e</table>", "a  b    c\nd       e"),
        ("<ol><li value=7>a<li>b<li value=x>c</ol>", "7. a\n8. b\n9. c"),
        ("<ol style='visibility:hidden'><li>a<li style='visibility:visible'>b</ol>", "2. b"),
        ("<div>" * 200 + "<p hidden>a<p>b<ul><li hidden>c<li>d</ul>", "b\n\nd"),
        ("<style>a" + " " * 5000 + "b > , > , > c, :x {display:none} i > {display:none}</style><b>a</b><i>b</i>", "ab"),
        ("<div>" * 200 + "<i style='visibility:hidden'>a</i>b", "b"),
        ("<style>.x{display:none}</style>" + "<div>" * 200 + "<div class=x>a<div>b</div>c</div>d", "d"),
    ],
)
def test_shown_as_in_a_browser(source, text):
    assert text_of(source) == text


@pytest.mark.parametrize("inner", ["<div>", "<b>", "<p hidden>", "<ul><li>", "<div style='visibility:hidden'>"])
def test_nested_hidden_page_is_linear(inner):
    page = "<div>" * 160 + "<div hidden>" + inner * 32_000 + "x"
    began = time.time()
    assert text_of(page) == ""
    assert time.time() - began < 3


def test_deep_and_long():
    assert text_of("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert len(text_of("<p>word</p>" * 20000)) == 6 * 20000 - 2


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a", "k"), (None, None, "k"), (1, "<p>a", "k")], "page_id long, html string, text string")
    assert sorted(map(tuple, extract_text(df).collect()), key=str) == [(1, "a"), (1, "a"), (None, None)]
    assert extract_text(df.limit(0)).count() == 0
