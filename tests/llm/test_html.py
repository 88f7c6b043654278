import html as entities
import itertools
import math
import random
import re

import numpy as np
import pytest

from patronage.llm import html


@pytest.fixture(scope="module")
def model(spark, folder):
    return html.learn(spark.read.parquet(f"{folder}/pages.parquet"), pages_used=60, examples=300)


def article(page):
    """Main text of the test pages by their known layout."""
    a, b = page.find("<article>"), page.find("</article>")
    inside = re.sub(r"<[a-zA-Z/!][^>]*$", "", page[a + 9:b if b >= 0 else len(page)])
    lines = (" ".join(entities.unescape(x).split())
             for x in re.split(r"</?(?:p|h1|b|br)>", inside))
    return "\n".join(x for x in lines if x)


def test_pages_give_their_articles(spark, folder, model):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages, model).collect()}
    right = 0
    for r in pages.collect():
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
        right += got[r.page_id].text == article(r.html)
    assert right >= 0.98 * len(got)


def test_unseen_layouts(model):
    good = total = 0
    for seed in range(50_000, 50_200):
        tree, label = html.example_page(seed)
        keep = html.decode(tree.parent, model.probability(html.describe(tree)))
        for text, k, want in zip(tree.text, keep, label):
            good += bool(text) and k == bool(want)
            total += bool(text)
    assert good / total > 0.9


def test_named_parts_go(model):
    page = """<html><body><div id="cookie-banner"><p>We use cookies.</p><button>OK</button></div>
      <header class="site-header"><a href="/">Home</a></header>
      <ul class="menu"><li><a href="#">One</a><li><a href="#">Two</a></ul>
      <div class="post-content"><h1>A title &amp; more</h1><p>First  paragraph,\n with words. It goes on
      for a while, so that it reads like text.<p>Second &lt;one&gt; with <a href="#">a link</a> in it,
      and again quite some words that make a line.</div>
      <section id="comments"><div class="comment"><p>Great post!</p></div></section>
      <script>document.write("<p>no</p>")</script><footer>&copy; us</footer></body></html>"""
    assert html.main_texts([page], model) == [
        "A title & more\nFirst paragraph, with words. It goes on for a while, so that it reads like "
        "text.\nSecond <one> with a link in it, and again quite some words that make a line."]


@pytest.mark.parametrize("seed", range(20))
def test_decoding_equals_all_labellings(seed):
    pick = random.Random(seed)
    n = pick.randint(1, 9)
    parent = [-1] + [pick.randrange(v) for v in range(1, n)]
    p = np.array([pick.random() for _ in range(n)])

    def worth(label):
        if any(label[v] and v and not label[parent[v]] for v in range(n)):
            return -math.inf
        return sum(math.log(p[v] if label[v] else 1 - p[v]) for v in range(n))
    best = max(itertools.product((False, True), repeat=n), key=worth)
    assert worth(html.decode(parent, p)) == pytest.approx(worth(best))


def test_parsing_mends_markup():
    def leaves(page):
        tree = html.parse(page)
        return [t for t in tree.text if t]
    assert leaves("<p>a<b>b</b>c<br>d<p>e") == ["abc d", "e"]
    assert leaves("<ul><li>x<li>y<ul><li>z</ul></ul>w") == ["x", "y", "z", "w"]
    assert leaves('a<img alt="<p>no</p>">b &amp;amp; &#233;&nbsp;&am') == ["a b &amp; é &am"]
    assert leaves("<style>p{}</style><title>t</title>x<!-- <p>c -->y<script>1</p>") == ["xy"]
    assert leaves("x < y and z</p></div> t <foo") == ["x < y and z", "t"]
    assert leaves(None) == leaves("") == leaves("<p></p>") == []
    assert leaves("<table><tr><td>1<td>2<tr><td>3</table>4") == ["1", "2", "3", "4"]
    deep = "<div>" * 3000 + "x"
    assert leaves(deep) == ["x"] and len(html.describe(html.parse(deep))) == 3002


def test_odd_rows(spark, model):
    rows = [(None, None, None), (1, "u", ""), (1, "u", "<p>"), (2, None, "plain text only, no markup at all.")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr(
        "*", "1 AS text", "2 AS n_chars", "3 AS id", "4 AS seed", "5 AS label")
    got = html.extract(pages, model).collect()
    assert len(got) == 4 and sum(r.n_chars == 0 for r in got) >= 3
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html.extract(none, model).count() == 0
    assert len(html.learn(none, examples=40, rounds=2, depth=2).trees) == 2


def test_formulas_stay_and_controls_go(model):
    page = """<html><body><nav><a href="/">Home</a></nav><article class="post-content"><h1>A title</h1>
      <p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn></math> be a number <button>Copy</button>that is larger
      than all others, which goes on for some words more.</p><p>Then <object>the inner text</object> and
      <svg><text>a label</text></svg> follow, with quite a few words to make a line.</p></article>
      </body></html>"""
    assert html.main_texts([page], model) == [
        "A title\nLet x+1 be a number that is larger than all others, which goes on for some words more.\n"
        "Then the inner text and a label follow, with quite a few words to make a line."]


def test_place_among_many_siblings():
    tree = html.parse("<div>" + "".join(f"<p>text {i}</p>" for i in range(120)) + "</div>")
    rows = html.describe(tree)
    places = [rows[v, 14] for v in range(len(tree.parent)) if tree.tag[v] == "p"]
    assert places == [i / 120 for i in range(120)]
