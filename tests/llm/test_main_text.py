"""Main text: the given pages against a plain reading, page layouts, and the style tree of a host."""

import html
import math
import re

import pytest
from pyspark.sql import functions as F

from riskflow.llm import main_text, queries

PAGES = "page_id long, url string, html string"


def text_of(page):
    return " ".join(b.text for b in main_text.Reader().read(page).chosen())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_equals_a_plain_reading_of_the_given_pages(spark, sf):
    path = f"/root/testdata/{sf}"
    want = {}
    for r in spark.read.parquet(f"{path}/pages.parquet").collect():
        # These pages put the article, and nothing else, into one element.
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside)))
        want[r.page_id] = (r.url, " ".join(plain.split()))
    got = queries.QUERIES["op13_html_extraction"](spark, path).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("a < b > c", "a < b > c"), ("<p>one<p>two<b>three</b>\n four", "one twothree four"),
    ("<html><head><title>t</title><body class='no-sidebar comments-open'><header>h</header><main><h1>H</h1><p>a&nbsp;&#233;</p></main><footer>f", "H a é"),
    ("<head><title>t</title><meta charset=x><p>x</p>", "x"),
    ("<body><div class='top-nav'>m</div><div id=content><h2>H</h2><div>text<br>more</div><div class='share'>s</div></div><div>other</div>", "H text more"),
    ("<article><header><h1>T</h1></header><p>a</p><aside>x</aside><form><input>q</form><div class=advert>b</div><p>c</p><section id=comments>"
     "<article class=comment><p>no</p></article></section><footer>f</footer></article>", "T a c"),
    ("<form><main><p>in a form</p><form><p>no</p></form></main></form>", "in a form"),
    ("<div class='layout-sidebar'><article><p>kept</p></article></div>", "kept"),
    ("<div class=sidebar><p>gone</p></div>", ""), ("<p hidden>x</p><p style='display: none'>y</p><p aria-hidden=true>z</p><p>k</p>", "k"),
    ("<p>a<script>var t='</p><p>';</script>b<!-- <p>c</p> --></p><style>p{}</style><noscript>n</noscript><p>d", "ab d"),
    ("<p>a<script>never closed <p>b</p>", "a"), ("<p>a<!-- never closed <p>b</p>", "a"), ("<p>a</p><p class=\"x", "a"),
    ("<ul><li>one<li>two<ul><li>three</ul><li>four</ul>", "one two three four"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<p title='a > b'>x</p><p title=\"q>y</p>", "x y"), ("<ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul><p>text</p>", "text"),
    ("<p>&lt;b&gt; &copy; &#x1F600; &notanentity;</p>", "<b> © \U0001F600 ¬anentity;"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<article>" + "<p>x y</p>" * 200_000, " ".join(["x y"] * 200_000)), ("<" * 50_000, "<" * 50_000), ("<b \"" * 20_000 + ">t", "t"),
])
def test_markup(page, text):
    assert text_of(page) == text


def site(n, words=lambda i: f"text number {i}"):
    return [(i, f"https://A.example.com/{i}", f"<body><div><p>Please accept our terms</p></div><div class=x><h2>News {i}</h2><p>{words(i)}</p>"
             f"{'<p>more</p>' * (i % 3)}</div><div class=y><ul><li>call us</li></ul></div></body>") for i in range(n)]


def test_branches_that_are_the_same_on_a_host_go(spark):
    rows = site(30) + [(100, "https://b.example.com/", site(1)[0][2]), (101, None, None), (None, "no host", site(1)[0][2])]
    rows += [rows[7]] * 40  # a page that repeats is no evidence
    pages = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("x"), "low": F.lit(1), "text": F.lit("t")}).repartition(5)
    whole = "Please accept our terms News 0 text number 0 call us"
    for sent in (main_text.SENT_NODES, 0):
        out = main_text.extract(pages, sent_nodes=sent).collect()
        assert len(out) == len(rows)
        got = {r.page_id: r.text for r in out}
        assert all(got[i] == f"News {i} text number {i}" + " more" * (i % 3) for i in range(30))
        assert got[100] == got[None] == whole and got[101] == ""


def test_a_host_of_near_copies_keeps_its_text(spark):
    out = main_text.extract(spark.createDataFrame(site(12, lambda i: "the very same words"), PAGES)).collect()
    assert all(r.text.startswith(f"News {r.page_id}") for r in out)


def test_importance_by_hand(spark):
    tree = main_text.style_tree(spark.createDataFrame(site(9), PAGES))
    rows = {round(r.importance, 6) for r in tree.filter("m = 9").collect()}
    # Three presentations (no, one, two further paragraphs collapse into p): h2 p only, so none; texts: 9 different.
    reader = main_text.Reader()
    node = next(b.node for b in reader.read(site(1)[0][2]).blocks if b.tag == "h2")
    terms = next(b.node for b in reader.read(site(1)[0][2]).blocks if b.text.startswith("Please"))
    paragraph = next(b.node for b in reader.read(site(1)[0][2]).blocks if b.text.startswith("text"))
    got = {r.node: r for r in tree.collect()}
    assert got[node].importance == 1 and got[terms].importance == 0 and got[terms].low
    assert got[paragraph].importance == pytest.approx(1 - math.log(6) / math.log(9) / 10)
    assert rows >= {0.0, 1.0} and all(r.branch >= r.importance for r in got.values())


def test_empty_table(spark):
    assert main_text.extract(spark.createDataFrame([], PAGES)).count() == 0
