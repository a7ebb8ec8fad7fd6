import random
import re
import time
from html import escape, unescape

import pytest

from leaksieve.llm.html_text import extract_text, main_text
from leaksieve.llm.queries import op11_html_extraction

ARTICLE = "<article><h1>A title</h1><p>First paragraph, with words.</p><p>Second.</p></article>"
TEXT = "A title\n\nFirst paragraph, with words.\n\nSecond."


@pytest.mark.parametrize("page", [
    ARTICLE,
    f"<html><head><title>t</title></head><body><nav><ul><li><a href=/x>Menu, menu.</a></ul></nav>{ARTICLE}<footer>&copy; All rights.</footer>",
    f"<body><header><h1>Site</h1><p>Slogan.</p></header><main><div class='breadcrumbs'>Home > Here</div>{ARTICLE}</main><aside><p>More, and more.</p></aside>",
    f"<div class='ad'>Buy this, now. Buy that.</div>{ARTICLE}<section id=comments><article class='comment'><p>I agree, and so on, and on.</p></article></section>",
    "<div id=top><p>Welcome, friends, to this fine site.</p></div><div id=content><h1>A title</h1><div class=cookiebar-x>We use cookies.</div>"
    "<p>First paragraph, with words.</p><p>Second.</p></div><div class='bottom'><p>Made by us, in 2020, with care.</p></div>",
    f"<form id=page><div role=navigation>Go, there.</div>{ARTICLE}<input value='x'><button>Send</button></form>",
    f"<div id='cookie-notice'>We use cookies, sorry.</div><div class=\"main-sidebar\">Side.</div>{ARTICLE}<script>document.write('<p>no</p>')</script>",
    f"<style>p {{ }}</style>{ARTICLE}<noscript><p>Turn on scripts.</p></noscript><template><p>x</p></template><!-- <p>hidden</p> -->",
    f"{ARTICLE}<div hidden>Secret.</div><div style='display: none'>Secret.</div><div aria-hidden=true>x</div><iframe src=x><p>y</p></iframe>",
    "<article><h1>A title</h1><p><b>First <i>paragraph</b>,</i> with\n words.<br><p>Second.<div class='share-buttons'>Tell, all.</div></article>",
    "<article><header><h1><a href=/x><span>A title</span></a></h1><p>by Somebody</p></header><p>First paragraph, with words.</p><!-- x --><p>Second.</article>",
    "<body class='has-sidebar'><article class='post no-sidebar'><h1>A title</h1><div class='post-content'><p>First paragraph, with words.</p>"
    "<p>Second.</p></div><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul></article></body>",
    '<article><h1>A title</h1><p title="a > b" data-x=\'<p>\'>First paragraph, with words.</p><p class=>Second.</p></article',
])
def test_what_lies_around_goes(page):
    assert main_text(page) == TEXT


def test_white_space_and_references():
    assert main_text("<article><p> a\n\t b&nbsp;c &amp;lt; &lt;p&gt; &#8364;&#x1F600; &eacute; &am &notanentity; 1 < 2 <3</p><p>\n</p><p>d</p></article>") == (
        "a b c &lt; <p> €\U0001F600 é &am \xacanentity; 1 < 2 <3\n\nd")


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("plain text, only.", "plain text, only."), ("<article></article>", ""),
    ("<article><p><a href=x>All of it is a link.</a></p></article>", "All of it is a link."),
    ("<article><p>one</p></article><article><p>two</p></article>", "one\n\ntwo"),
    ("<article><p>cut <b", "cut"), ("<article><p>cut</p><!-- open <p>no</p>", "cut"), ("<article><p>x</p><script>no</p>", "x"),
    ("<article><ul><li>one, two<li>three, four</ul><table><tr><td>a, b<td>c, d</table></article>", "one, two\n\nthree, four\n\na, b\n\nc, d"),
    ("</p></div></article><article><p>x</div></section>y</article>", "xy"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_page_without_named_article():
    """Ratios of paths alone decide: paragraphs stay with their heading, also short ones; links and small print go."""
    rng = random.Random(2)
    body = [" ".join(rng.choice(["stone", "river", "hill,", "rain."]) for _ in range(rng.choice([2, 60, 90]))) for _ in range(9)]
    page = ("<div class=top><div><a href=/>Home</a></div><ul>" + "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(12)) + "</ul></div>"
            "<div><h2>The heading</h2>" + "".join(f"<p>{p}</p>" for p in body) + "</div><table><tr><td>Made in 2020.<td>Contact</table>")
    assert main_text(page) == "\n\n".join(["The heading", *body])


def test_reading_is_linear():
    torn = "<a title=\"x' " * 20000
    deep = "<div>" * 60000 + "text, here." + "</div>" * 60000
    for page in ("<" * 300000, torn, "<!--" * 80000, "<b>" * 60000 + "</b>" * 60000, deep, "<p><b>x" * 40000, "</x>" * 90000, "<script>" * 50000,
                 "<td>" * 60000, "<li>" * 60000, "<article><p>" + "many words, " * 300000):
        start = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - start < 5
    assert main_text(deep) == "text, here."
    assert len(main_text("<article><p>" + "many words, " * 300000)) == 12 * 300000 - 1


def generated(rng):
    """A page and its article's text: menus, notices, forms, comments and markup of several kinds around it."""
    def prose(n):
        return " ".join(rng.choice(["the", "of", "hill", "rain,", "& so", "x < y", "stone.", "über"]) for _ in range(n))

    title, paragraphs = prose(5), [prose(rng.choice([1, 3, 40, 200])) for _ in range(rng.randrange(1, 8))]
    around = [
        f"<nav><a href=/>{escape(prose(9))}</a></nav>", f"<div class='{rng.choice(['ad', 'advert-top', 'sponsored'])}'>{escape(prose(60))}</div>",
        f"<aside><p>{escape(prose(70))}</p></aside>", f"<form><label>{escape(prose(8))}</label><input></form>",
        f"<div id='{rng.choice(['cookieBanner', 'gdpr', 'site-notice'])}'><p>{escape(prose(50))}</p></div>",
        f"<section class='reader-comments'><p>{escape(prose(90))}</p></section>", f"<script>var x = '<p>{prose(20)}</p>';</script>",
        f"<footer>{escape(prose(40))}</footer>", f"<!-- {prose(4)} -->"]
    rng.shuffle(around)
    cut = rng.randrange(len(around))
    tag = rng.choice(["article", "main", "div class='post-content'"])
    inside = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p class=x><em>{}</em></p>", "<blockquote>{}</blockquote>"]).format(escape(p)) for p in paragraphs)
    page = f"<html><body>{''.join(around[:cut])}<{tag}><h1>{escape(title)}</h1>{inside}</{tag.split()[0]}>{''.join(around[cut:])}"
    return page, "\n\n".join([title, *paragraphs])


def test_generated_pages(spark):
    rng = random.Random(11)
    pages = [(i, f"http://x/{i}", *generated(rng)) for i in range(300)]
    pages += [pages[0], (None, None, None, ""), (7, None, "", "")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string").selectExpr("*", "1 AS n_chars")
    rows = extract_text(frame).collect()
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted([(r.page_id, r.url, r.text) for r in rows], key=key) == sorted([(i, u, t) for i, u, _, t in pages], key=key)
    assert all(r.n_chars == len(r.text) for r in rows)
    assert extract_text(frame.limit(0)).collect() == []


def test_whole_table(spark):
    """Against a plain cut of the given pages, whose articles have only h1, p, b and br."""
    sf = "/root/testdata/sf0.01"
    expected = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", article)]
        expected[r.page_id] = (r.url, "\n\n".join(p for p in parts if p))
    rows = op11_html_extraction(spark, sf).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == expected and len(rows) == len(expected)
