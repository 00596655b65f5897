"""Main text of pages built from known parts, and of the given pages, whose main text stands in one article element."""

import html as entities
import re

import numpy as np
import pytest

from footgrid.llm import html

TABLE = html.table()
TREE = html.fit_tree(TABLE[:, :-1], TABLE[:, -1])


def text(page):
    return html.main_text(page, TREE)


def test_tree_fits_its_table():
    assert all(html.keep(TREE, row[:-1]) == bool(row[-1]) for row in TABLE)


LONG = "This paragraph tells the story of the house by the river and of all the people who lived in it over the years, one after the other."
PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
     f"<article><h1>Title</h1><p>{LONG}</p><p>Yes.</p><p>{LONG} <a href=x>more</a></p><section class='comments'><p>{LONG}</p></section></article>"
     f"<footer>&copy; {LONG}</footer></body></html>", f"Title {LONG} Yes. {LONG} more"),
    (f"<body><div id='cookie-notice'>{LONG}</div><div class=content><p>A &amp; b&nbsp;c &#233;</p><p>in<b>line</b> x<br>y</p></div><aside>{LONG}</aside>"
     f"<form><p>{LONG}</p></form><div class='ad'>{LONG}</div></body>", "A & b c é inline x y"),
    (f"<div><p>{LONG}</p><p>{LONG}</p></div><script>var a = '<p>{LONG}</p>';</script><!-- <p>{LONG}</p> --><textarea><p>{LONG}</p></textarea>", f"{LONG} {LONG}"),
    (f"<main><p>{LONG}<p>{LONG}<div>Short</div>", f"{LONG} {LONG} Short"),
    ("<ul><li><a>one</a><li><a>two</a></ul>", ""), ("", ""), ("<", ""), (f"<article>{LONG}", LONG), ("<!-- open", ""), ("<script>never closed", ""),
    ("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>", " ".join([LONG] * 3000)),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_known_pages(page, want):
    assert text(page) == want


def test_given_pages_and_rows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        assert got[r.page_id] == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
    odd = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<article>x y</article>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.text for r in html.extract(odd).collect())) == ["", "", "x y"]
    assert html.extract(odd.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    (f"<html class='no-js has-nav'><body class='single has-sidebar'><p>{LONG}</p><p>{LONG}</p></body></html>", f"{LONG} {LONG}"),
    (f"<body class='home sidebar'><p>{LONG}</p><p>{LONG}</p><aside>{LONG}</aside></body>", f"{LONG} {LONG}"),
    (f"<main class='content with-sidebar'><p>{LONG}</p><p>Yes.</p></main><div class=sidebar>{LONG}</div>", f"{LONG} Yes."),
    (f"<main class=sidebar-right><p>{LONG}</p></main>", LONG),
    (f"<article class='post comments-open'><p>{LONG}</p><p>Yes.</p></article>", f"{LONG} Yes."),
    (f"<article class='post related-posts'><p>{LONG}</p></article>", LONG),
    (f"<div class='sidebar-layout'><p>{LONG}</p><article><p>{LONG} Yes.</p></article></div>", f"{LONG} Yes."),
    (f"<div class='content with-sidebar'><p>{LONG}</p><p>Yes.</p></div>", f"{LONG} Yes."),
    (f"<article><p>{LONG}</p><div class=comments><article><p>{LONG}</p></article></div></article>", LONG),
    (f"<main><p>{LONG}</p></main><div id=comments><article class=comment-body><p>{LONG}</p></article></div>", LONG),
    (f"<main><p>{LONG}</p></main><aside><article><p>{LONG}</p></article></aside>", LONG),
    (f"<article class=comment><p>{LONG}</p></article><div class=side-bar>{LONG}</div><div class=ad-box>{LONG}</div>", ""),
])
def test_names_of_templates(page, want):
    assert text(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<body><a name=top><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></body>", f"Head {LONG} {LONG}"),
    (f"<body><article><p><a href=x>open anchor {LONG}</p><p>{LONG}</p><p>{LONG} <a href=y>more</a></p></article></body>", f"{LONG} {LONG} more"),
    (f"<div title=it's><p>{LONG}</p></div><div title=they're><p>{LONG}</p></div>", f"{LONG} {LONG}"),
    (f'<div title="a > b" data-x=\'it"s\' hidden=""><p>{LONG}</p></div><p class=">">{LONG}', f"{LONG} {LONG}"),
    (f'<p title="never closed>{LONG}</p><p>{LONG}</p>', f"{LONG} {LONG}"),
    (f"<article><section class='share-classes'><p>{LONG}</p></section><p class=menu-planning>{LONG}</p></article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><div class='share-buttons'><p>{LONG}</p></div><div id=related_posts>{LONG}</div><ul class='social-links'><li>{LONG}</ul></article>", LONG),
    (f"<p>{LONG}</p><ul><li>One</li><li>Two words</li><li>Three</li></ul><p>{LONG}</p>", f"{LONG} One Two words Three {LONG}"),
    (f"<ul><li><a href=a>Home</a></li><li>Two</li><li>Three</li></ul><p>{LONG}</p><ul><li>x</li><li>y</li></ul>", LONG),
    (f"<p>{LONG}</p><a href=t><div>Teaser text of a card that is one link</div></a><p>{LONG}</p>", f"{LONG} {LONG}"),
    ("<a href=x>" * 2000 + f"<p>{LONG}</p>", LONG), ("<div class=" * 3000, ""), ("<a href=' " * 3000 + f"<p>{LONG}</p>", None),
])
def test_odd_markup(page, want):
    assert want is None and isinstance(text(page), str) or text(page) == want


def reader(page):
    """Blocks of a page by the standard library's parser: the text of every block element and what stands in it, menus and the like left out."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.found, self.now, self.quiet = [], [], []

        def close_block(self):
            if "".join(self.now).split():
                self.found.append(" ".join("".join(self.now).split()))
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag in html.BLOCK or tag in html.SKIPPED:
                self.close_block()
            if tag in html.SKIPPED - html.VOID or tag in html.OUTSIDE | {"header"} or any(k == "class" and v in ("ad", "comments") for k, v in attrs):
                self.quiet.append(tag)

        def handle_endtag(self, tag):
            if tag in html.BLOCK or tag in html.SKIPPED:
                self.close_block()
            if self.quiet and self.quiet[-1] == tag:
                self.quiet.pop()

        def handle_data(self, data):
            if not self.quiet:
                self.now.append(data)

    r = Reader()
    r.feed(page)
    r.close_block()
    return " ".join(r.found)


def test_held_out_pages_of_many_shapes():
    """Made pages that are in no table: every main block kept, every other one dropped, like a real parser that knows which parts are quiet."""
    import random
    rng = random.Random(7)
    words = "stone river garden winter letter morning window people story answer market field".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    for k in range(60):
        body = "".join(rng.choice([f"<p>{say(rng.randint(25, 80))}</p>", f"<p>{say(40)} <a href='/{k}'>{say(2)}</a> {say(9)}</p>",
                                   f"<p>{say(30)}</p><ul>" + "".join(f"<li>{say(rng.randint(1, 6))}</li>" for _ in range(4)) + f"</ul><p>{say(20)}</p>",
                                   f"<h2>{say(4)}</h2><p>{say(50)}</p>", f"<blockquote>{say(25)}</blockquote><p>{say(30)}</p>"]) for _ in range(rng.randint(2, 6)))
        shell = rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<div id=content>{}</div>", "<article class='post has-share'>{}</article>"])
        menu = "<nav><ul>" + "".join(f"<li><a href='/m{i}'>{say(1)}</a></li>" for i in range(6)) + "</ul></nav>"
        page = f"<html><head><title>{say(3)}</title></head><body><header><p>{say(4)}</p></header>{menu}{shell.format(body)}<div class='ad'><p>{say(30)}</p></div>" \
               f"<div class=comments><p>{say(40)}</p></div><aside>{say(50)}</aside><footer>{say(12)}</footer></body></html>"
        assert text(page) == reader(page), page


def test_long_page_in_linear_time():
    import time
    page = "<article>" + "".join(f"<p class='x y'>{LONG} <a href=z>w</a></p>" for _ in range(30_000)) + "</article>"
    begin = time.time()
    assert len(text(page)) > 3_000_000 and time.time() - begin < 60
