"""Main text of made pages, and of all test pages by their article element."""

import html
import re

import pytest

from panoquarry.llm import html_text
from tests.llm.helpers import table_rows

SCHEMA = "page_id long, url string, html string, host string, main string, text string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "h", "m", "t") for r in rows], SCHEMA)
    return {r["page_id"]: r["text"] for r in html_text.extract(spark, df).collect()}


def test_whole_table(spark, sf_dir):
    """In these pages the article element is all main text, with no unwanted part within."""
    got = {r["page_id"]: r for r in html_text.extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    rows = table_rows(sf_dir, "pages", "page_id, url, html")
    assert len(got) == len(rows)
    for page, url, source in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
        inner = re.sub(r"<script.*?</script>|<!--.*?-->", "", inner, flags=re.S)
        inner = re.sub(r"</?(?:p|h\d|br|li|ul|div)\b[^>]*>", " ", inner)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
        assert got[page]["text"] == want, page
        assert got[page]["n_chars"] == len(want) and got[page]["url"] == url


PARTS = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="content">{main}</div><aside>side</aside><div class="comments"><p>first!</p></div>
<form><input>send</form><script>var x="<p>no</p>";</script><footer>foot &copy;</footer></body></html>"""


def test_unmarked_host(spark):
    """A host without article elements: the container with most text, whatever else pages have."""
    bodies = ["<h2>A &amp; B</h2><p>one\n two<br>three<p>fo<b>u</b>r", "<p>x &lt;y&gt; &#233;</p><div class=ad>buy</div><ul><li>p<li>q</ul>", "<p>only</p>"]
    got = run(spark, [(i, "http://h.example/x", PARTS.replace("{main}", b)) for i, b in enumerate(bodies)])
    assert got == {0: "A & B one two three four", 1: "x <y> é p q", 2: "only"}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a.example", ""), (3, "http://a.example", "plain text only"), (4, "http://a.example", "<article><header><h1>t</h1></header><p>cut off <b>he"), (5, None, "<article>a<div class='share'>s</div>b</article>"), (6, "http://a.example", "<article>" + "<p>long</p>" * 20000), (6, "http://a.example", "</p></div><p"), (7, "x", '<article title="a>b"><p>q</p></article><!-- c')]
    got = run(spark, rows)
    assert got[1] == "" and got[3] == "plain text only" and got[4] == "t cut off he" and got[5] == "a b" and got[7] == "q"
    assert run(spark, []) == {}


@pytest.mark.parametrize("a, b, want", [("<nav>x</nav><p>t</p>", "<p>t</p>", "(<nav>#</nav>)?#"), ("<div class=i>1</div><div class=i>2</div>", "<div class=i>1</div>", "(<div.i>#</div.i>)+"), ("<div><p>1</p></div>", "<div><ul><li>1</ul></div>", "<div>(#)?(<ul>#</ul>)?</div>")])
def test_alignment(a, b, want):
    one, two = (html_text.wrapper_of(html_text.Page(x, tree=True).root[1]) for x in (a, b))
    assert html_text.expression(html_text.align(one, two)) == want
    assert html_text.align(one, one) == one


def test_template_text(spark):
    """What is word for word at one place of all pages goes, whatever its class; elsewhere it stays."""
    ask = "<div class='x7'>Read with us</div>"
    page = "<article><p>one {0}</p><p>two {0}</p>{1}<p>All rights kept.</p></article>"
    rows = [(i, "http://t.example/x", page.format(f"word{i}", ask)) for i in range(6)]
    rows += [(9, "http://t.example/x", page.format("<b>last</b></p><p>All rights kept.</p><p>x", ask)), (10, "http://one.example", page.format("a", ask))]
    got = run(spark, rows)
    assert all(got[i] == f"one word{i} two word{i}" for i in range(6))
    assert got[9].count("All rights kept.") == 2 and "Read with us" not in got[9]
    assert got[10] == "one a two a Read with us All rights kept."


def test_identical_pages_keep_their_text(spark):
    rows = [(i, "http://c.example/x", "<article><p>a</p><p>b</p></article>") for i in range(5)]
    assert set(run(spark, rows).values()) == {"a b"}


@pytest.mark.parametrize("part", ['<section id="discussion">k</section>', '<h2 id="related-work">k</h2>', '<h2 id="social-impact">k</h2>', '<p class="side-effects">k</p>', '<section id="search-algorithms">k</section>', '<div id="copyright-law">k</div>', '<div id="related-work" class="section">k</div>', '<div class="ad-hoc-networks">k</div>'])
@pytest.mark.parametrize("outer", ["article", "main"])
def test_words_in_a_text(outer, part):
    source = f"<{outer}><p>a</p>{part}<div class='share-buttons'>s</div><div id='comments'>c</div><p class='advert'>b</p></{outer}>"
    assert [b[1] for b in html_text.Page(source).blocks if not b[3]] == ["a", "k"]


def test_words_in_headings_of_unmarked_pages():
    source = "<div class=content><h2 id='related-work'>h</h2><p class='side-effects'>k</p><div class='left-sidebar'>x</div></div>"
    assert [b[1] for b in html_text.Page(source).blocks if not b[3]] == ["h", "k"]


def test_text_beside_the_heaviest_container(spark):
    """Headings, intros, siblings, rarer layouts and lists of links in an article are main text too."""
    menu = "<div class=m1><a href=/>home</a> <a href=/x>all pages</a></div>"
    nested = menu + "<div class=content><h1>h{0}</h1><p>intro{0}</p><section>" + "long{0} " * 20 + "</section></div>"
    three = menu + "<div class=intro>i{0}</div><div class=body>" + "b{0} " * 30 + "</div><div class=outro>o{0}</div>"
    rare = menu + "<div class=body>note{0}</div><div class=story>" + "s{0} " * 30 + "</div>"
    refs = "<article><p>text{0} of it</p><ul><li><a href=/r>ref{0}</a></ul></article>"
    rows = [(i, f"http://{h}.example/", page.format(i)) for i, (h, page) in enumerate([("n", nested)] * 4 + [("t", three)] * 8 + [("t", rare)] + [("r", refs)] * 4)]
    got = run(spark, rows)
    for i in range(4):
        assert got[i] == f"h{i} intro{i}" + f" long{i}" * 20
    for i in range(4, 12):
        assert got[i] == f"i{i}" + f" b{i}" * 30 + f" o{i}"
    assert got[12] == "note12" + " s12" * 30
    for i in range(13, 17):
        assert got[i] == f"text{i} of it ref{i}"


@pytest.mark.parametrize("tag", ["div", "blockquote", "section", "b", "ul><li", "article"])
def test_very_deep_pages(spark, tag):
    """What is nested deeper than any bound keeps its text, and what follows is read as usual."""
    nested = f"<{tag}>" * 30_000 + "<p>deep text</p>" + "".join(f"</{x}>" for x in tag.split("><")[::-1]) * 30_000
    rows = [(i, "http://d.example/x", f"<main><p>before {i}</p>{nested}<p>after</p></main><nav>menu</nav>") for i in range(2)]
    want = "deep text" if tag == "article" else "before {0} deep text after"
    assert run(spark, rows) == {i: want.format(i) for i in range(2)}


def test_many_layouts_of_one_host(spark):
    """More different trees than one task folds; template text is told over all of them."""
    page = "<div class=top>Read with us</div><article>{0}</article>"
    body = lambda i: "".join(f"<{('div', 'section', 'ul')[i // 3**k % 3]}>w{i}-{k}</{('div', 'section', 'ul')[i // 3**k % 3]}>" for k in range(6))
    n = html_text.FOLD * 4 + 1
    got = run(spark, [(i, "http://m.example/x", page.format(body(i))) for i in range(n)])
    assert got == {i: " ".join(f"w{i}-{k}" for k in range(6)) for i in range(n)}


@pytest.mark.parametrize("source", ["<div class='layout with-sidebar'><article><p>a</p></article></div>", "<article class='post social-science'><p>a</p></article>", "<body class='has-sidebar'><main class='search-theory'><p>a</p></main></body>"])
def test_class_words_around_an_article(source):
    assert html_text.page_text(source + "<div class=sidebar>s</div>") == "a"


def test_alignment_decides_text(spark, monkeypatch):
    """Without alignment the words that all pages of a host share stay in."""
    rows = [(i, "http://t.example/x", f"<article><p>word{i}</p><div>Read with us</div></article>") for i in range(6)]
    assert set(run(spark, rows).values()) == {f"word{i}" for i in range(6)}
    monkeypatch.setattr(html_text, "OFTEN", 101)
    assert set(run(spark, rows).values()) == {f"word{i} Read with us" for i in range(6)}
