"""HTML extraction on pages of known articles."""

import os
import random
import re
from html import escape, unescape

import pytest

from lectern.llm.html import blocks_of, extract, main_text
from lectern.llm.html_queries import op9_html_extraction

SF_DIR = "/root/testdata/sf0.01"
WORDS = "the of and to in that was for on are with his they at be this from have water house stone river light".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def clutter(rng):
    link = '<li><a href="/x">%s</a></li>'
    return [f"<nav><ul>{''.join(link % w for w in WORDS[:6])}</ul></nav>", f"<header><h1>{sentence(rng, 3)}</h1></header>",
            f'<div class="cookie-notice">{sentence(rng, 12)} <button>OK</button></div>',
            f'<aside><p>{sentence(rng, 30)}</p></aside>', f'<div id="ad-top">{sentence(rng, 9)}</div>',
            f'<form action="/s"><label>Search</label><input name=q><p>{sentence(rng, 8)}</p></form>',
            f'<section class="comments"><div class="comment"><p>{sentence(rng, 40)}</p></div></section>',
            f"<script>var a = '<p>{sentence(rng, 5)}</p>';</script>", "<style>p > b { margin: 0 }</style>",
            f"<!-- <p>{sentence(rng, 20)}</p> -->", f"<footer><p>&copy; {sentence(rng, 25)}</p></footer>"]


@pytest.mark.parametrize("wrapped", ["article", "main", None])
def test_article_among_clutter(wrapped):
    rng = random.Random(9)
    for _ in range(40):
        texts = [sentence(rng, rng.randint(1, 60) if wrapped else rng.randint(16, 60)) for _ in range(rng.randint(1, 9))]
        texts[0] += " a < b & c"
        body = "".join(f"<p>{escape(t)}" + rng.choice(["</p>", "", "\n </p>"]) for t in texts)
        if wrapped:
            inside = rng.choice(["", '<aside class="related"><a href="/">more of this</a></aside>'])
            body = f"<{wrapped}>{body}{inside}</{wrapped}>"
        before, after = rng.sample(clutter(rng), 4), rng.sample(clutter(rng), 4)
        page = f"<!DOCTYPE html><html><head><title>{sentence(rng, 4)}</title></head><body>" + "".join(
            before) + ("</p>" + body) + "".join(after) + rng.choice(["</body></html>", ""])
        assert main_text(page) == "\n".join(re.sub(r"\s+", " ", t).strip() for t in texts)


def test_markup():
    assert main_text("<article><p>a&nbsp;&eacute;&#233;&#x41;  \n <b>b</b>old<br>x &lt;p&gt;</article>") == "a ééA bold x <p>"
    assert main_text("<article><p>one<br><br>two</article>") == "one\ntwo"
    assert main_text('<article title="a>b"><p class=\'x>y\'>text</p></article>') == "text"
    assert main_text("<article><p>cut off <b") == "cut off"
    assert main_text("<nav><a href=/>menu</a><article>text") == "text"
    assert main_text("<main><header><h1>Title</h1></header><p>Text.</p><aside>side</aside></main>") == "Title\nText."
    assert main_text('<article><ul><li>one<li>two</ul></article>') == "one\ntwo"
    assert main_text('<article class="comment"><p>text</p></article>') == ""
    assert main_text("plain text without any markup") == "plain text without any markup"
    assert main_text(None) == main_text("") == "" and main_text("<") == "<"


ONE, TWO = (f"{w} of the house that was by the river had the light of the water in it, and all of this is from the time when they "
            f"had come to it with his stone and {w} for the others." for w in ("The keeper", "The sailor"))


@pytest.mark.parametrize("opened", [
    '<div class="container has-sidebar">', '<form id="aspnetForm">', '<div class="post social-sharing-enabled">', '<div class="widget">',
    '<div id="page-header"><div class="ad-free">', '<article class="teaser"><p>More.</p></article><div>', '<div class="banner"><form>'])
def test_names_and_forms_around_the_prose(opened):
    page = f'<body><nav><a href="/">Home</a></nav>{opened}<p>{ONE}</p><p>Short.</p><p>{TWO}</p></form></div></div>'
    assert main_text(page + "<footer>All rights are with us</footer>") == f"{ONE}\nShort.\n{TWO}"


def test_parts_around_an_article():
    assert main_text(f'<article><div class="entry-header"><h1>Title</h1></div><p>{ONE}</p></article>') == f"Title\n{ONE}"
    assert main_text(f'<div class="notice"><p>{ONE}</p><p>{TWO}</p><p>{ONE}</p></div><article><p>{TWO}</p></article>') == TWO
    assert main_text(f'<div><p>{ONE}</p></div><div class="comments"><p>{TWO}</p><p>{TWO}</p><p>{TWO}</p></div>') == ONE
    assert main_text(f'<article><a href="/">Soon.</a></article><div><p>{ONE}</p><p>{TWO}</p></div>') == f"{ONE}\n{TWO}"
    codes = "x1 = y2 + z3; " * 9
    assert main_text(f"<article><p>{ONE}</p><pre>{codes}</pre></article>") == f"{ONE}\n{codes.strip()}"


def test_hostile_pages_take_linear_time():
    for page in ('<a "' * 100_000, '<p x="' * 100_000, "<div>" * 50_000 + "x", "<" * 300_000, "<!--" * 100_000,
                 "<script>" * 100_000, "<div class=widget>" * 50_000 + "x", "&" * 300_000, "<article><p>" + "word " * 200_000):
        blocks_of(page)


def test_ambiguous_blocks_follow_their_neighbours():
    long = "This is the text of the article and it has many of the words that are found in all of the texts there are."
    page = f'<div><a href="/">a menu of links</a></div><p>Short.</p><div>{long}</div><p>Short too.</p><div>{long}</div>'
    assert main_text(page) == f"Short.\n{long}\nShort too.\n{long}" or main_text(page) == f"{long}\nShort too.\n{long}"


def test_awkward_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>" + "word " * 100_000, "x"), (3, "v", "<article>t", "x"),
            (3, "v", "<article>t", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df, carry=["page_id", "text"]).selectExpr("_carry.page_id", "_carry.text AS extra", "text").collect()
    assert sorted(((r["page_id"], r["extra"], len(r["text"])) for r in got), key=repr) == sorted(
        [(1, "x", 0), (None, "x", 0), (2, "x", 499_999), (3, "x", 1), (3, "x", 1)], key=repr)
    assert extract(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")
def test_supplied_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op9_html_extraction(spark, SF_DIR).collect()}
    assert got.keys() == pages.keys()
    for page, html in pages.items():
        article = re.search("<article>(.*?)</article>", html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", b))).strip()
                  for b in re.split("</?(?:p|h1|br)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[page]["text"] == want and got[page]["n_chars"] == len(want)
