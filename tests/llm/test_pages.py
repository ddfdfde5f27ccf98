"""Main text of pages: broken markup, wrappers, and a plain version over all given pages."""

import re
import time
from html.parser import HTMLParser

import pytest

from textlab.llm.common import table
from textlab.llm.pages import extract_pages, main_text

TEXT = "This is the paragraph that we have written for the test of the page and it is long enough to be good in the end, as you can see from it."
LONG = " ".join([TEXT] * 3)


@pytest.mark.parametrize("page, wanted", [
    (f'<div class="site comments-open"><article><p>{LONG}</p></article></div>', LONG),
    (f'<div class="right-sidebar"><p>{LONG}</p></div><div class="sidebar"><p>{TEXT}</p></div>', LONG),
    (f'<div id="search-results"><p>{LONG}</p></div>', LONG),
    (f"<a name=top><p>{LONG}</p>", LONG),
    (f"<a href=#top><p>{LONG}</p><p>{LONG}</p>", LONG + "\n" + LONG),
    (f'<article><p>{LONG}</p></article><article class="comment"><p>{LONG}</p></article>', LONG),
    (f'<article><p>{LONG}</p><div class="comments"><article class="comment reply"><p>{LONG}</p></article></div></article>', LONG),
    (f"<p>{LONG}</p><p hidden>{LONG}</p><div style='color:red; display: none'><p>{LONG}</p></div>", LONG),
    (f"<p>{LONG} \N{COPYRIGHT SIGN} 2020 by us</p><p>\N{COPYRIGHT SIGN} 2020 the owner of the page</p>", f"{LONG} \N{COPYRIGHT SIGN} 2020 by us"),
    (f"<p>{LONG}</p><p>See <a href=x>here</a> for the rest.</p><p>{LONG}</p>", f"{LONG}\nSee here for the rest.\n{LONG}"),
    (f'<article><section class="social-security"><p>{LONG}</p></section></article>', LONG),
    (f'<article><p>{LONG}</p><div class="social share"><p>{TEXT}</p></div></article>', LONG),
    (f"<article><p>{LONG}</p><table><tr><td><label>Name of it</label></td></tr></table></article>", LONG + "\nName of it"),
    (f"<header><h1>The title</h1><p>Home</p></header><p>{LONG}</p>", "The title\n" + LONG),
    (f"<header><h1>The site</h1></header><article><h1>The title</h1><p>{LONG}</p></article>", "The title\n" + LONG),
    (f"<form action=x><div><p>{LONG}</p></div></form><form><p>Your name</p></form>", LONG),
    (f'<article><p>{LONG}</p><svg class="i"/><p title="a>b">{LONG}</p></article>', LONG + "\n" + LONG),
    ("", ""), (None, ""), ("<", ""), ("<p", ""), ("<script>" + LONG, ""),
])
def test_pages(page, wanted):
    assert main_text(page) == wanted


@pytest.mark.parametrize("unit", [
    '<a href="', '<p "', "<script ", "<div>", "<div></p>", '<p "x>"', "<!--", "</", '<div class="ad">', "<p '\"x>", "<script></script", "<svg>", "<style>", "<a href=x>", "</div>", "&", "<p =\"'>",
])
def test_time_follows_the_page(unit):
    """Four times the page is about four times the time, not sixteen times."""
    def seconds(n):
        page = unit * n + ("</div>" * n if unit == "<div>" else "")
        started = time.process_time()
        main_text(page)
        return time.process_time() - started

    seconds(1000)
    assert seconds(40_000) < 9 * max(seconds(10_000), 0.05)


class Plain(HTMLParser):
    """Blocks of the article, taken by its elements alone."""

    OUT = re.compile(r"\b(ad|ads|share|related|comments?|newsletter|promo|cookie|sidebar|notice|nav|menu)\b")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.out, self.now = 0, [], [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        hint = self.OUT.search(f"{named.get('class') or ''} {named.get('id') or ''} {named.get('role') or ''}".lower().replace("-", " "))
        if tag in ("script", "style", "nav", "aside", "footer", "form", "button") or hint and tag in ("div", "section", "ul"):
            self.skip.append(tag)
        elif self.skip and tag == self.skip[-1]:
            self.skip.append(tag)
        if tag == "article":
            self.depth += 1
        if tag == "br":
            self.now.append(" ")
        elif tag not in ("a", "b", "i", "em", "strong", "span", "code", "img", "sub", "sup"):
            self.cut()

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "em", "strong", "span", "code", "sub", "sup"):
            self.cut()
        if self.skip and tag == self.skip[-1]:
            self.skip.pop()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.now.append(data)


def plainly(page):
    parser = Plain()
    parser.feed(page or "")
    parser.close()
    parser.cut()
    return "\n".join(parser.out)


def test_given_pages_equal_a_plain_version(spark):
    rows = table(spark, "/root/testdata/sf0.01", "pages")
    made = {r["page_id"]: r["text"] for r in extract_pages(rows).collect()}
    assert made and made == {r["page_id"]: plainly(r["html"]) for r in rows.collect()}
