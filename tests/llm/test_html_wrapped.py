"""Articles inside elements that are asides elsewhere, and asides that stay asides."""

import itertools

import pytest

from sparrowdex.llm.html_extract import extract

ARTICLE = "".join(f"<p>Paragraph {k} tells of the river, its banks, and the people who have lived along them for a very long time.</p>" for k in range(20))
WANT = "\n".join(f"Paragraph {k} tells of the river, its banks, and the people who have lived along them for a very long time." for k in range(20))
WRAPS = {
    "form": ("<form id=aspnetForm><input type=hidden value=x><label>Search</label><button>Go</button>", "</form>"), "hidden": ("<div hidden>", "</div>"), "aria": ("<div aria-hidden='true'>", "</div>"), "style": ('<div style="display: none">', "</div>"),
    "role": ("<div role=complementary>", "</div>"), "header": ("<header>", "</header>"), "named": ("<div class=widget>", "</div>"), "dialog": ("<dialog open>", "</dialog>"),
}
BODIES = ["<body>", "<body style='display:none'>", "<body aria-hidden=true>", "<body hidden class=menu role=form>"]
AROUND = "<nav><ul><li><a href=/a>Home page</a></li><li><a href=/b>About us and more</a></li></ul></nav>{}<footer>Copyright of the publisher, all rights reserved.</footer>"


@pytest.mark.parametrize("wraps", [*itertools.combinations(WRAPS, 1), *itertools.permutations(WRAPS, 2)], ids="-".join)
def test_an_article_in_wrappers(wraps):
    page = ARTICLE
    for w in wraps:
        page = WRAPS[w][0] + page + WRAPS[w][1]
    for body in BODIES:
        assert extract(f"<html>{body}{AROUND.format(page)}</body></html>") == WANT


@pytest.mark.parametrize("tag", ["nav", "footer", "aside", "form", "header"])
def test_a_marked_article_in_any_part(tag):
    for mark in ("main", "article"):
        assert extract(f"<body><{tag}><{mark}>{ARTICLE}</{mark}></{tag}><p>Short.</p></body>") == WANT


@pytest.mark.parametrize("wrap", [w for w in WRAPS if w != "named"] + ["named"])
def test_asides_beside_an_article_stay_out(wrap):
    part = f"{WRAPS[wrap][0]}<p>Subscribe to our letter and never miss any of the offers that we have for you.</p>{WRAPS[wrap][1]}"
    for whole in (f"<article>{ARTICLE}</article>", ARTICLE):
        assert extract(f"<body>{AROUND.format(part + whole + part)}</body>") == WANT


def test_an_advert_longer_than_a_short_article():
    assert extract("<body><div class=ad>Buy this thing that nobody needs, it is cheap today.</div><article><h1>News</h1><p>A short note of today.</article><footer>All rights reserved by us.</footer></body>") == "News\nA short note of today."


def test_a_whole_form_of_controls():
    """A form's text stays, what it asks with goes."""
    page = f"<body><form>{ARTICLE}<fieldset><legend>Your mail</legend><label>Mail</label><select><option>one</option></select><textarea>x</textarea><button>Send</button></fieldset></form></body>"
    assert extract(page) == WANT
