"""Pages whose visible text is easily lost."""

import re

import pytest

from oddsframe.llm import htmltext


@pytest.mark.parametrize(("page", "want"), [
    ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
    ("<table><form><tr><td>a</td></tr></form></table>c", "a\n\nc"),
    ("<table><tbody><td>a<td>b</table>", "a  b"),
    ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ("<table><tr>loose<td>a</td></tr></table>", "loose\n\na"),
    ("<table><tbody><p>one<p>two<tr><td>a</td>three</tr></tbody>four</table>", "one\n\ntwo\n\nthreefour\n\na"),
    ("<table><tr><div>x<td>a</div>b</td></tr></table>", "x\n\nab"),
    ("<table><tr><td>a<table><tr></td><td>b</table>c</td><td>d</table>", None),
    ("<table><caption>cap<div>in</div><td>a</table>", "cap\nin\na"),
    ("<table><tr><td>a</td><table><tr><td>b</table>", "a\n\nb"),
    ("<table><colgroup><col><tr><td>a</table>", "a"),
    ("<table><tr><noscript><td>no</td></noscript><td>a</table>", "a"),
])
def test_tables_keep_all_text(page, want):
    found = htmltext.visible_text(page)
    if want is not None:
        assert found == want
    else:
        assert sorted(found.split()) == sorted(re.sub("<[^>]*>", " ", page).split())


def test_no_text_of_random_tables_is_lost():
    import random

    rng = random.Random(4)
    tags = "table tbody thead tr td th caption form div p b ul li span".split()
    for _ in range(400):
        words = [f"w{k}x" for k in range(30)]
        page = "".join(f"<{rng.choice(['', '', '/'])}{rng.choice(tags)}>" + (w if rng.random() < 0.7 else "") for w in words)
        assert sorted(re.findall(r"w\d+x", htmltext.visible_text(page))) == sorted(re.findall(r"w\d+x", page)), page


@pytest.mark.parametrize(("css", "shown"), [
    ("@media print{.x{display:none}}", True),
    ("@media print{.y{color:red}.x{display:none}} .z{display:none}", True),
    ("@media (max-width:600px){.x{display:none}}", True),
    ("@media screen and (max-width: 40em){.x{display:none}}", True),
    ("@media only screen and (min-width:768px){.x{display:none}}", False),
    ("@media (width >= 600px){.x{display:none}}", False),
    ("@media (600px <= width <= 900px){.x{display:none}}", True),
    ("@media not print{.x{display:none}}", False),
    ("@media print, screen{.x{display:none}}", False),
    ("@media (min-width:1px){@media print{.x{display:none}}}", True),
    ("@supports (display:grid){.x{display:none}}", False),
    ("@import url(a;b.css); .x{display:none}", False),
    ("@keyframes k{from{opacity:0}} .x{display:none}", False),
    (".x{display:none} .x{display:block}", True),
    (".x{display:none} .x{color:red}", False),
    (".x{display:none!important} .x{display:block}", False),
    (".x{display:block} p{display:none}", True),
    ("p{display:none} #i{display:block}", True),
    (".x{visibility:hidden} .x{visibility:visible}", True),
    (".x{display:block;visibility:hidden}", False),
    (".x{/* display:none; */color:red}", True),
    ("/* .x{display:none} */", True),
    (".q{content:'}.x{display:none}'}", True),
    (".x{color:red;display:none", False),
    (".a .x{display:none}", True),
    (".y{.x{display:none}}", True),
])
def test_only_rules_for_the_screen_hide(css, shown):
    assert htmltext.visible_text(f"<style>{css}</style><p id=i class='x'>text") == "text" * shown


def test_style_attributes_and_elements():
    assert htmltext.visible_text("<style>.x{display:none}</style><p class=x style='display:block'>a<p style='display:block;display:none'>b<p style=\"color:red; /* x */ DISPLAY:NONE\">c") == "a"
    assert htmltext.visible_text("<style media=print>p{display:none}</style><noscript><style>p{display:none}</style></noscript><p>a") == "a"
    assert htmltext.visible_text("a<style/>p{}<p>b") == "a"


@pytest.mark.parametrize(("page", "want"), [
    ("<div style='visibility:hidden'>a<p style='visibility:visible'>b</p>c</div>d", "b\n\nd"),
    ("<div style='visibility:hidden'>a<p style='visibility:inherit'>b</p></div>d", "d"),
    ("<div style='display:none'>a<p style='display:block;visibility:visible'>b</p></div>d", "d"),
    ("<style>.v{visibility:visible}</style><ul style='visibility:hidden'><li>a<li class=v>b</ul>", "- b"),
    ("<table style='visibility:collapse'><tr><td>a<td style='visibility:visible'>b</table>", "b"),
    ("<p hidden>a<p hidden style='display:block'>b", "b"),
    ("<style>p{display:block}</style><p hidden>a", "a"),
    ("<ul>one <b>two</b> three<li>a</li>four <i>five</i></ul>", "one two three\n- a\nfour five"),
    ("<table><tr><td colspan=2>a wide heading</td><td>x</td></tr><tr><td>a</td><td>b</td><td>y</td></tr></table>", "a wide heading  x\na  b            y"),
    ("<table><tr><td>漢字</td><td>x</td></tr><tr><td>abcd</td><td>y</td></tr></table>", "漢字  x\nabcd  y"),
    ("<input value=a> <input type=hidden value=b> <input type=password value=c> <input type=submit value=d>", "a   d"),
])
def test_visibility_lists_and_columns(page, want):
    assert re.sub(" +", " ", htmltext.visible_text(page)) == re.sub(" +", " ", want) if "input" in page else htmltext.visible_text(page) == want


def test_hidden_parts_stay_hidden_at_any_depth():
    """Random trees far beyond DEPTH against a plain walk with one flag for each open element."""
    import random

    rng = random.Random(9)
    opens = ["<b>", "<div>", "<i>", "<span>", "<b hidden>", "<div style='display:none'>", "<i style='visibility:hidden'>", "<span style='visibility:visible'>"]
    for _ in range(60):
        page, want, stack, word = [], [], [(False, False)], 0
        for _ in range(rng.choice([100, 400, 1500])):
            if rng.random() < 0.75 or len(stack) == 1:
                tag = rng.choice(opens[:4]) if rng.random() < 0.99 else rng.choice(opens[4:])
                gone, hidden = stack[-1]
                stack.append((gone or "none" in tag or tag == "<b hidden>", (hidden or "y:hidden" in tag) and "y:visible" not in tag))
                page.append(tag)
                names.append(tag[1:-1].split()[0]) if len(stack) > 2 else (names := [tag[1:-1].split()[0]])
            else:
                stack.pop()
                page.append(f"</{names.pop()}>")
            if rng.random() < 0.3:
                word += 1
                page.append(f" w{word}x ")
                if not any(stack[-1]):
                    want.append(f"w{word}x")
            if rng.random() < 0.02:
                page.append("<script>var no;</script><style>q{}</style>")
        assert htmltext.visible_text("".join(page)).split() == want


def test_deep_pages_in_linear_time():
    deep = 200_000
    assert htmltext.visible_text("<b>" * deep + "x<script>no</script>y" + "</i>" * deep + "</b>" * deep + "z") == "xyz"
    assert htmltext.visible_text("<div>" * 5000 + "a<p>b<table><tr><td>c<td>d</table>e<style>.x{display:none}</style><p class=x>no</p>f").split() == list("abcdef")
    assert htmltext.visible_text("<table><tr><td>" + "<b>" * 500 + "a<td>b</table>c").split() == list("abc")
    assert htmltext.visible_text("<ul><li>" + "<b>" * 500 + "a<li>b</ul>") == "- a\n- b"
