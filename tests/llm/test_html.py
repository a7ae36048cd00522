from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import html as H

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def scores(spark):
    return H.default_model(spark)


def test_messages_are_exact_marginals():
    r = random.Random(3)
    pair = ((math.log(0.8), math.log(0.2)), (math.log(0.1), math.log(0.9)))
    for _ in range(30):
        n = r.randint(2, 9)
        parent = [-1, *[r.randrange(i) for i in range(1, n)]]
        odds = [0.0, *[r.gauss(0, 2) for _ in range(1, n)]]
        total, on = 0.0, [0.0] * n
        for labels in itertools.product((0, 1), repeat=n - 1):
            y = (0, *labels)
            w = math.exp(sum(odds[i] * y[i] + pair[y[parent[i]]][y[i]] for i in range(1, n)))
            total += w
            for i in range(1, n):
                on[i] += w * y[i]
        got = H.marginals(parent, odds, pair)
        assert [1 / (1 + math.exp(-x)) for x in got[1:]] == pytest.approx([x / total for x in on[1:]], abs=1e-9)


def test_long_chains_of_elements(scores):
    deep = "<div>" * 3000 + "<p>Some words at the bottom of it all, and more.</p>"
    assert isinstance(H.extract(deep, scores), str)


def test_article_only(scores):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var x='</p><p>no'</script></head><body>"
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav><div class='ad'>Buy this now, and save.</div>"
        "<article><h1>A  title &amp; more</h1><p>First &lt;p&gt; paragraph,\n with a <b>bold <i>word</b></i>.<br>And a line.<p>Second one, it has <a href='#'>a link</a> in it."
        "<!-- not <p>this</p> --></p><ul><li>Point one<li>Point two</ul></article><aside><p>Read more here, dear reader.</p></aside>"
        "<section class='comments'><div class='comment'><p>I think it is wrong. Really.</p></div></section><footer>&copy; 2024 Someone.</footer></body></html>"
    )
    assert H.extract(page, scores) == "A title & more\nFirst <p> paragraph, with a bold word. And a line.\nSecond one, it has a link in it.\nPoint one\nPoint two"


@pytest.mark.parametrize("source", [None, "", "<", "</p></div>", "<p", "<!--", "<script>", "&#xD800;&#0;&bogus;", "<article>", "<p>\x00</p>"])
def test_broken_pages(scores, source):
    assert isinstance(H.extract(source, scores), str)


@pytest.mark.parametrize("unit", ['<a "', "<a '", '<a b="', "<p title=\"x>", "</b></i>", "<li></li>", "<!--", "<script>", "<", "<ul><li>", "</div>", '<a b="<', "<td>x", "&amp", "<dl><dt>"])
def test_hostile_pages_take_time_in_proportion(scores, unit):
    """The work of a page grows with its bytes, whatever it repeats, alone or below many open elements."""
    import time

    took = []
    for n in (4000, 16000):
        source = "<div>" * n + unit * n
        began = time.perf_counter()
        H.Page(source)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.3


def test_broken_tags_leave_no_markup(scores):
    assert [t for _, t in H.Page('<article><p title="x>Hello world.').blocks] == ["Hello world."]
    assert [t for _, t in H.Page("<article><p class=a <b>Bold</b> text.</p>").blocks] == ["Bold text."]
    assert [t for _, t in H.Page('<p title="a > b" x=\'<i>\'>One</p>1 < 2 and 3 > 2').blocks] == ["One", "1 < 2 and 3 > 2"]
    assert [t for _, t in H.Page("<style>p > a{}</style><script>if (a<b) '</p>' </script>x<SCRIPT></Script >y").blocks] == ["x y"]


#: Pages by hand, of other makes than the training's: (html, article).
BY_HAND = [
    ("<!doctype html><html lang=en><head><meta charset=utf-8><title>Harbour to reopen</title></head><body class=site><div id=masthead><a href=/>The Courier</a><div class=tagline>All the coast's news</div></div>"
     "<div id=nav-main><ul><li><a href=/a>Local</a><li><a href=/b>Sea</a></ul></div><div id=wrap><div class=entry-content><h1>Harbour to reopen in May</h1><p>The old harbour will open again after two years of repairs, the council said on Friday.</p>"
     "<p>Fishing boats return first. Ferries follow in June, once the pier has been tested.</p></div><div class=sidebar-right><h4>Most read</h4><ol><li><a href=/1>Storm warning lifted</a></li></ol></div></div><div class=site-footer><p>Courier Media Ltd.</p></div></body></html>",
     ["Harbour to reopen in May", "The old harbour will open again after two years of repairs, the council said on Friday.", "Fishing boats return first. Ferries follow in June, once the pier has been tested."]),
    ("<body><header role=banner><a href=/>Kitchen notes</a></header><nav role=navigation><a href=/r>Recipes</a> | <a href=/t>Tips</a></nav><main><article class=recipe><header><h2>Plain bread</h2></header><section><p>Mix flour, water, salt and yeast. Leave the dough overnight in a cool place.</p>"
     "<ul><li>500 g of flour</li><li>350 g of water</li></ul><p>Bake it hot for forty minutes, until the crust is dark.</p></section></article></main><section id=comments><p>Lovely, thanks! Mine was a little flat.</p></section><footer role=contentinfo>Write to us.</footer></body>",
     ["Plain bread", "Mix flour, water, salt and yeast. Leave the dough overnight in a cool place.", "500 g of flour", "350 g of water", "Bake it hot for forty minutes, until the crust is dark."]),
    ("<html><body><table class=layout><tr><td class=menu><a href=1>Start</a><br><a href=2>Archive</a></td><td class=maintext><h3>A walk in the hills</h3><p>We set out before dawn, when the valley still lay in fog. The path climbs slowly at first.</p><p>At noon we reached the top, ate our bread, and looked at the sea.</p></td></tr></table>"
     "<div class=cookie-bar>This site uses cookies. <button>Fine</button></div></body></html>",
     ["A walk in the hills", "We set out before dawn, when the valley still lay in fog. The path climbs slowly at first.", "At noon we reached the top, ate our bread, and looked at the sea."]),
]


def test_pages_by_hand(scores):
    """Not from the training's generator: share of blocks judged right."""
    right = total = 0
    for source, want in BY_HAND:
        got = H.extract(source, scores).split("\n")
        for _, text in H.Page(source).blocks:
            total += 1
            right += (text in got) == (text in want)
    assert right / total >= 0.9, (right, total)


def test_held_out_accuracy(spark):
    """Trained on half of the labelled shapes, blocks of the other half come out right."""
    pages = H.labelled_pages()
    random.Random(1).shuffle(pages)
    half = len(pages) // 2
    model = H.train(spark.createDataFrame([(p,) for p in pages[:half]], "html string"))
    right = total = 0
    for p in pages[half:]:
        page = H.Page(p)
        got = set(H.extract(re.sub(r'\s*data-content="?[01]"?', "", p), model).split("\n"))
        for i, text in page.blocks:
            right += (page.mark[i] == 1) == (text in got)
            total += 1
    assert right / total > 0.97


def test_rows(spark, scores):
    article = "<article><h1>Title</h1><p>The committee met again, and it went on until late.</p></article>"
    rows = [(1, "u", article), (1, "u", article), (None, None, None), (2, "v", "")]
    df = spark.createDataFrame(rows, PAGE).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in H.extract_pages(df, scores).collect()))
    want = "Title\nThe committee met again, and it went on until late."
    assert got == [(0, "", 0), (1, want, len(want)), (1, want, len(want)), (2, "", 0)]
    assert H.extract_pages(df.filter(F.lit(False)), scores).collect() == []


def test_query_over_whole_table(spark, sf):
    """The test pages keep their text in one article element, whose blocks can be read plainly."""
    import html

    from spanloom.llm.queries import op10_html_extraction

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in op10_html_extraction(spark, sf).collect()}
    assert got.keys() == pages.keys()
    for k, source in pages.items():
        inner = re.search(r"<article>(.*)</article>", source, re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|h2|li|ul)\b[^>]*>", inner))
        assert got[k]["text"] == "\n".join(filter(None, blocks))
        assert got[k]["n_chars"] == len(got[k]["text"])


NAMES = ["commentary", "article alerting", "post-replying", "story recommended", "widgetized-content", "postBody", "relatedness", "replica news"]


@pytest.mark.parametrize("name", NAMES)
def test_a_name_counts_whole(scores, name):
    body = "<h1>The new bridge</h1><p>The bridge opened on Monday after two years of work. Many people came to see it.</p>"
    page = f'<html><body><nav><a href="/">Home</a></nav><div class="{name}">{body}</div><div class="comment-list"><p>I do not like it. Not at all.</p></div><footer>c</footer></body></html>'
    assert H.extract(page, scores) == "The new bridge\nThe bridge opened on Monday after two years of work. Many people came to see it."
