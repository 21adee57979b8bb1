import random
import time

import pytest

from marketrisk.llm import pages as html
from marketrisk.llm.pages import visible_text

CASES = {
    "<p>One <b>two</b>\n three<p>Four": "One two three\n\nFour",
    "<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>end": "- a\n- b\n  3. x\n  4. y\n\nend",
    "<table><tr><td>1<td>long<tr><th>333<td>z</table>": "1    long\n333  z",
    "<table><td>lone</table>": "lone",
    "<div>a<div hidden>no</div><script>if(a<b)</script><!-- c -->b</div>": "ab",
    "<style>.ad, #x {display : none}</style><p class='big ad'>no</p><i id=x>no</i>yes": "yes",
    "<span style='visibility:hidden'>q<i style='visibility: visible'>seen</i></span>": "seen",
    "<head><title>t</title></head><body>&amp;&lt;&#233; &nbsp;</body>": "&<é \xa0",
    "<pre>  a\n    b</pre>": "  a\n    b",
    "a<br><br>b": "a\n\nb",
    "<p>unclosed <b>bold<p>next</b></table></div>": "unclosed bold\n\nnext",
    "": "",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert visible_text(page) == CASES[page]


def test_deep_and_broken_markup():
    assert visible_text("<div>" * 20_000 + "deep") == "deep"
    assert "x" in visible_text("<table><tr><td>" * 300 + "x")
    assert visible_text("<<<a <b>>") is not None


def test_every_cell_word_is_kept():
    rows = "".join(f"<tr><td colspan={k % 3}>w{k} " + f"<td>long {'v' * (k % 100)}{k}" for k in range(200))
    text = visible_text(f"<table>{rows}</table>")
    assert all(f"w{k}" in text for k in range(200))


def test_frame(spark):
    pages = spark.createDataFrame([(1, "<p>a", "old"), (1, "<p>a", "old"), (None, None, None), (2, "", "z")], "page_id int, html string, text string")
    assert sorted(html.extracted(pages).select("page_id", "text").collect(), key=str) == sorted(
        [(1, "a"), (1, "a"), (None, None), (2, "")], key=str
    )
    assert html.extracted(pages.limit(0)).count() == 0


STYLES = {
    "@media print{.x{display:none}}": "<p class=x>shown",
    "@media (max-width:600px){.x{color:red}.x{display:none}}": "<p class=x>shown",
    "@media screen{.x{display:none}}": "<p class=x>no</p>shown",
    "@import url(a;b.css);.x{display:none}": "<p class=x>no</p>shown",
    "/* .x{ */.x{content:'}';display:none}": "<p class=x>no</p>shown",
    ".tab{display:none} .tab.active{display:block}": "<p class='tab active'>shown<p class=tab>no",
    ".tab{display:none} .tab{display:block}": "<p class=tab>shown",
    ".tab{display:block} .tab{display:none}": "<p class=tab>no</p>shown",
    ".tab{display:none;display:flex}": "<p class=tab>shown",
    ".tab{display:none!important} .tab{display:block}": "<p class=tab>no</p>shown",
    "#x{display:none} .y{display:block} p{display:block}": "<p id=x class=y>no</p>shown",
    ".x{display:none} .open > .x{display:block}": "<div class=open><p class=x>shown</div>",
    ".x{display:none} .x::after{display:block}": "<p class=x>no</p>shown",
    ".hidden{display:none} @media(min-width:768px){.md\\:block{display:block}}": "<p class='hidden md:block'>shown<p class=hidden>no",
    ".x{display:none} ": "<p class=x style='display:block'>shown<p class=x style='color:red'>no",
    ".m{display:flex} [hidden]{display:none!important}": "<p class=m hidden>no</p>shown",
    ".m{display:flex}": "<p class=m hidden>shown",
    ".y{display:none}</style><noscript><style>.x{display:none}</style></noscript><style>": "<p class=x>shown",
    ".y{display:none}</style><style media=print>.x{display:none}": "<p class=x>shown",
}


@pytest.mark.parametrize("css", STYLES)
def test_only_what_the_cascade_hides_is_left_out(css):
    assert visible_text(f"<style>{css}</style>{STYLES[css]}") == "shown"


def test_styles_apply_wherever_they_stand():
    assert visible_text("<style>.x{display:none}</style><p class=x>shown<style>.x{display:block}</style>") == "shown"
    assert visible_text("<p class=x>no</p>shown<style>.x{display:none}</style>") == "shown"


@pytest.mark.parametrize(
    "page, text",
    {
        "<head><title>t</title><h1>Hello</h1><p>text": "Hello\n\ntext",
        "<html><head><title>t</title>Hello <b>you": "Hello you",
        "<head><noscript><img src=x>no</noscript><meta name=a><x-own>a</x-own>": "a",
        "<body>a<head><title>t</title></head>b": "ab",
        "<svg class=icon /><p>after": "after",
        "a <math/>b": "a b",
        "<svg><title>no</title><path d='M0'/><title/><text x=1>one</text><text>two</text></svg>": "one two",
        "x <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>": "x y=2",
        "<svg><defs><text>no</text></defs><p>after": "after",
        "<svg><defs><text id=t>used</text></defs><use href='#t'/></svg>": "used",
        "<map name=m><p>in a map<area></map>": "in a map",
    }.items(),
)
def test_open_heads_drawings_and_formulas(page, text):
    assert visible_text(page) == text


BROKEN = {
    "<p>a<![foo[bar]]>b": "ab",
    "a<![ x>b": "ab",
    "a<!doctype html [ x>b": "ab",
    "a<!>b<!x": "ab",
    "<p>a<![CDATA[x]]>b": "ab",
    "<svg><text><![CDATA[x > y]]></text></svg>b": "x > y b",
    "<svg><text><![CDATA[x": "x",
    f"<ol start='{'9' * 5000}'><li>x</ol>": "1000000000. x",
    f"<table><tr><td colspan='{'0' * 5000}'>x<td>y</table>": "x  y",
}


@pytest.mark.parametrize("page", BROKEN, ids=range(len(BROKEN)))
def test_broken_declarations_and_numbers(page):
    assert visible_text(page) == BROKEN[page]


def test_no_markup_raises():
    draw = random.Random(3)
    parts = ["<", ">", "</", "<!", "<!--", "-->", "<![", "]]>", "<?", "&", "&#", "&#x", ";", '"', "'", "=", "/>", " ", "\n", "x", "0", "\x00"]
    parts += ["9" * 30, "\ud800", "<p>", "<li>", "<ul>", "<ol start=", "<table>", "<td colspan=", "<tr>", "<style>", ".a{", "display:none}", "<svg>", "<title/>", "</p>"]
    parts += ["</td>", "<head>", "<body>", "<script>", "<template>", "<pre>", "<text>", "</svg>", "<use>", "<dd>", "<![CDATA["]
    for _ in range(10_000):
        page = "".join(draw.choices(parts, k=draw.randrange(30)))
        assert isinstance(visible_text(page), str)


DEEP = {
    "lists": "<li>a<ul>" * 8000,
    "blocks": "<div>" * 8000 + "x",
    "unclosed": "<div><table><td>" + "<span>" * 4000 + "</div>" * 4000,
    "rules": "<style>" + "".join(f".a.b{k}{{display:block}} .c{k}{{display:none}}" for k in range(4000)) + "</style>"
    + "".join(f"<p class='a c{k}'>no" for k in range(4000)),
    "one rule": "<style>" + ".x{display:none} .x.y{display:block}" * 4000 + "</style>" + "<p class=x>no" * 4000,
    "drawings": "<svg>" + "<g>" * 4000 + "<path/>" * 4000,
}


@pytest.mark.parametrize("name", DEEP)
def test_time_is_in_proportion_to_the_page(name):
    begin = time.process_time()
    text = visible_text(DEEP[name])
    assert time.process_time() - begin < 2 and len(text) < 100 * 8000 and "no" not in text


def test_a_long_cell_leaves_other_rows_aligned():
    rows = [("1", "a", "x"), ("22", "bb", "y"), ("3", "long " * 30 + "end", "z")]
    page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in r) for r in rows) + "</table>"
    assert visible_text(page) == "\n".join(["1   a   x", "22  bb  y", "3", "long " * 30 + "end", "z"])


def test_indents_stop_growing_and_keep_their_markers():
    lines = visible_text("<ol><li>x" * 100).split("\n")
    assert [line.strip() for line in lines] == ["1. x"] * 100
    assert lines[0] == "1. x" and len(lines[50]) == len(lines[99]) <= html.LONGEST_INDENT + 4
