import random
import time

import pytest

from seamline.llm import html_text
from seamline.llm.html_text import render


def test_hidden_content():
    page = "<html><head><title>t</title><style>x</style></head><body><p>a<!-- no --><span style='display: none'>b</span><script>if (a < b) {}</script><p hidden>c</p><noscript>d</noscript>e</body></html>"
    assert render(page) == "a\n\ne"


def test_implied_tags_and_lists():
    assert render("<p>a<p>b<ul><li>c<li>d<ol start=3><li>e<li>f</ol></ul>g") == "a\n\nb\n\n- c\n- d\n  3. e\n  4. f\n\ng"


def test_head_without_end_tag():
    assert render("<html><head><title>t</title><h1>Hello</h1><p>text") == "Hello\n\ntext"
    assert render("<head>\n<meta charset=x><style>s</style>\n<noscript><img alt=n>no</noscript><script>z</script>plain <b>bold</b>") == "plain bold"
    assert render("<head><title>t</title><link rel=x></head><body>b") == "b"


def test_colgroup_without_end_tag():
    assert render("<table><colgroup><col><col><tr><td>a<td>b</table>c") == "a  b\n\nc"
    assert render("<table><colgroup><col><colgroup><col>\n<tbody><tr><td>a</table>") == "a"
    assert render("<table><colgroup><col>loose<tr><td>a</table>") == "loose\na"


def test_formulas_drawings_and_options():
    assert render("<p>so <math><semantics><mrow><mi>a</mi><mspace/><mo>+</mo><mn>1</mn></mrow><annotation>a+1</annotation></semantics></math> holds") == "so a+1 holds"
    icons = "<path d='M0'/>" * 300
    assert render(f"<p>x<svg viewBox='0'><title>t</title><defs><text>no</text></defs>{icons}raw<text>la<tspan>bel</tspan></text><g><text>two</text></g></svg>y") == "x label two y"
    assert render("<svg><foreignObject><div>in<div/>side</div></foreignObject></svg>") == "in\nside"
    assert render("<svg><path d=M0><p>after") == "after"
    assert render("<select><option>one<option selected>two<optgroup label=G><option label=three>3</select>z") == "one\ntwo\nG\nthree\nz"


def test_tables_are_aligned():
    page = "<table><caption>Cap</caption><tr><th>name<th>n<tr><td>日本<td>1<tr><td>abcdef<td>22<td>x</table>"
    assert render(page) == "Cap\nname    n\n日本    1\nabcdef  22  x"
    assert render("<table><tr><td colspan=2>ab<td>c<tr><td>x<td>y<td>z</table>") == "ab     c\nx   y  z"


def test_blocks_pre_and_entities():
    assert render("<h1>T &amp; U</h1>x<br>y<hr>z<pre>  a\n   b</pre><blockquote>q</blockquote>") == "T & U\n\nx\ny\nz\n\n  a\n   b\n\n  q"


def test_broken_markup_keeps_text():
    assert render("</div><b>a<i>b</b>c<p>d</span>e<") .split() == ["abc", "de<"]
    assert render("<table>loose<tr><td>a") == "loose\na"
    assert "deep" in render("<div>" * 5000 + "deep")
    assert "x" in render("<table><tr><td>" * 300 + "x")
    assert render("<table><tr><td colspan='²'>a<td colspan=0>b<td colspan=99999999999>c</table>") == "a  b  c"


def test_quotes_and_empty_comments():
    assert render("<p title=it's>Hello</p> I don't know <b>x</b> end") == "Hello\n\nI don't know x end"
    assert render("a<!-->b<p>c") == "ab\n\nc"
    assert render("a<!--->b<!-- x --!>c<!-- <p>d") == "abc"
    assert render('a<p title="cut <b>off') == "a"


def test_hidden_at_any_depth():
    for depth in (10, 250, 5000):
        assert render("<div>" * depth + "<p hidden>secret</p>seen") == "seen"
        assert render("<div hidden>" + "<div>" * depth + "secret" + "</div>" * depth + "</div>seen") == "seen"
    assert render("<div hidden><span><div>x</span></div>y</div>z") == "z"


def test_visibility():
    assert render("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c</div>d") == "b\nd"
    assert render("<p hidden style='display:block'>a<p style='display:none;display:inline'>b<p style='display:none!important;display:block'>c") == "a\n\nb"
    assert render("<details>x<summary>s</summary>body</details><details open><summary>t</summary>more</details>") == "s\nt\nmore"
    assert render("<dialog>no</dialog><dialog open>yes</dialog><input type=hidden value=h><p aria-hidden=true>p") == "yes\n\np"
    assert render("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>") == "  b"  # the hidden cell keeps its column


def test_scopes():
    assert render("<div>a<table><tr><td>b</div>c</table>d") == "a\n\nbc\n\nd"
    assert render("<ul><li>a<ul><li>b</ul>c<li>d</ul>") == "- a\n  - b\n  c\n- d"
    assert render("<b>a<div>b</b>c</div>d</h2>e") == "a\nbc\nde"
    assert render("x</p>y</body>z") == "x\n\nyz"


BIG = {
    "unfinished": "<a " * 1_700_000,
    "attributes": "<a " * 1_700_000 + ">x",
    "open quotes": '<a x="' * 800_000,
    "stray ends": "<b>" * 700_000 + "</i>" * 700_000 + "x",
    "paragraphs": "<p><b>" * 300_000 + "x",
    "lists": "<ul><li>" * 150_000 + "x",
    "tables": "<table><tr><td>" * 100_000 + "x",
    "spans": "<table><tr>" + "<td colspan=1000>a" * 100_000 + "x",
}


@pytest.mark.parametrize("name", BIG)
def test_pages_of_megabytes_take_linear_time(name):
    began = time.perf_counter()
    text = render(BIG[name])
    assert time.perf_counter() - began < 20
    assert text.endswith("x") or name in ("unfinished", "open quotes")


def plain_tokens(page):
    """The states of the standard's tokeniser, a character at a time: texts, and tags with their attributes."""
    out, state, text, tag, i = [], "data", "", None, 0
    name = value = quote = ""

    def put():
        if name.lower() not in tag[2] and name:
            tag[2][name.lower()] = value

    while i < len(page):
        c = page[i]
        i += 1
        if state == "data":
            after = page[i : i + 2]
            if c == "<" and after[:1].isalpha() or c == "<" and after[:1] == "/" and after[1:].isalpha():
                tag = [c, "", {}, after[:1] == "/"]
                i += tag[3]
                state = "tag name"
            elif c == "<" and page.startswith("!--", i):
                i += 3
                if page.startswith(">", i) or page.startswith("->", i):
                    i = page.index(">", i) + 1
                else:
                    ends = [e for mark in ("-->", "--!>") if (e := page.find(mark, i)) >= 0]
                    i = page.index(">", min(ends)) + 1 if ends else len(page)
            elif c == "<" and (after[:1] in ("!", "?") and after or after[:1] == "/" and len(after) == 2):
                i = page.find(">", i + 1) + 1 or len(page)
            else:
                text += c
            continue
        if text:
            out.append(text)
            text = ""
        if state == "tag name":
            if c in " \n/":
                state = "before name"
            elif c != ">":
                tag[1] += c.lower()
        elif state in ("before name", "after name") and not (state == "after name" and c == "="):
            if c in " \n/":
                if c == "/" and state == "after name":
                    put()
                    name, state = "", "before name"
            elif c != ">":
                if state == "after name":
                    put()
                name, value, state = c, "", "name"
            elif state == "after name":
                put()
                name = ""
        elif state == "name" and c not in " \n/=>":
            name += c
        elif c == "=" and state in ("name", "after name"):
            state = "before value"
            continue
        elif state == "name":
            if c == " " or c == "\n":
                state = "after name"
                continue
            put()
            name, state = "", "before name"
        elif state == "before value":
            if c in " \n":
                continue
            if c in "\"'":
                quote, state = c, "quoted"
                continue
            if c != ">":
                value, state = c, "unquoted"
                continue
            put()
        elif state == "quoted":
            if c == quote:
                put()
                name, state = "", "before name"
            else:
                value += c
            continue
        elif state == "unquoted":
            if c not in " \n>":
                value += c
                continue
            put()
            name, state = "", "before name"
        if c == ">":
            out.append((tag[3], tag[1], tag[2]))
            state, name = "data", ""
    return out + [text] if text and state == "data" else out


def our_tokens(page):
    out, at, text = [], 0, ""
    while at < len(page):
        rest = page[at + 1 : at + 3]
        if page[at] == "<" and (rest[:1].isalpha() or rest[:1] == "/" and rest[1:].isalpha()):
            found = html_text.tag_at(page, at)
            if text:
                out.append(text)
                text = ""
            if found is None:
                return out
            at, tag, source, ends = found
            out.append((ends, tag, html_text.attributes_of(source)))
        elif page[at] == "<" and (rest[:1] and rest[:1] in "!?" or len(rest) == 2 and rest[0] == "/"):
            at, _ = html_text.markup_end(page, at)
        else:
            text += page[at]
            at += 1
    return out + [text] if text else out


def test_tokens_of_random_markup_against_the_states_of_the_standard():
    rng = random.Random(4)
    parts = ["<", ">", "<b", "</b", "<p ", "a", "x=", "=", '"', "'", " ", "/", "<!--", "-->", "--", "!", "?", "-", "<!", "\n", "it's", "/>"]
    for _ in range(30_000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert our_tokens(page) == plain_tokens(page), page


def test_random_markup_loses_no_text():
    rng = random.Random(5)
    tags = "p div b span ul ol li table tr td th blockquote h1 pre a i section select option svg".split()
    for _ in range(2_000):
        words, page = [], ""
        for k in range(rng.randrange(1, 30)):
            tag = rng.choice(tags)
            page += rng.choice([f"<{tag}>", f"</{tag}>", f"<{tag} title=it's>"])
            if rng.random() < 0.5:
                words.append(f"w{k}")
                page += f" w{k} "
        if "svg" in page:
            continue
        assert sorted(w for w in render(page).split() if w[0] == "w") == sorted(words), page


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (None, "<p>a", "z"), (3, "<p>b", "z"), (3, "<p>b", "z")], "page_id long, html string, text string")
    rows = sorted(((r["page_id"] or 0, r["text"]) for r in html_text.extract(df).collect()))
    assert rows == [(0, "a"), (1, ""), (2, ""), (3, "b"), (3, "b")]
    assert html_text.extract(df.limit(0)).isEmpty()
