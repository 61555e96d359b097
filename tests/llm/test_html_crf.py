import html
import itertools
import os
import re
import time

import numpy as np
import pytest

from samplecraft.llm import html_crf as H

SF = "/root/testdata/sf0.01"


def test_blocks():
    got = H.blocks("<p>a <b>b</b>&amp;c<p>d<br>e  \n f</p><!-- x --><script>if (a<b) '</p>'</script><div>g<ul><li>h<li>i</ul>j"
                   "</div><title>no</title><style>p{}</style>k &lt;b&gt;&nbsp;l<unclosed")
    assert [b.text for b in got] == ["a b&c", "d e f", "g", "h", "i", "j", "k <b> l<unclosed"]
    assert got[3].path[-1] == "last:li" and "in:p" not in got[2].path and H.blocks("") == [] == H.blocks("<p></p> ")
    inner = H.blocks('<div class="post-body"><div id=cookie-notice><p>x</p></div><p>y</p></div>')
    assert "near:notice" in inner[0].path and "name:text" in inner[0].path and "near:text" in inner[1].path


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_viterbi_is_the_best_path(n):
    rng = np.random.default_rng(n)
    page = [H.Block(" ".join("x" * k), (f"f{i}",), 0) for i, k in enumerate(rng.integers(1, 40, n))]
    names = {f for b in H.features(page) for f in b}
    model = H.Model({k: float(rng.normal()) for k in sorted(names)}, tuple(map(tuple, rng.normal(size=(2, 2)).tolist())))

    def score(y):
        s = sum(model.weights[f] for i, b in enumerate(H.features(page)) if y[i] for f in b)
        return s + sum(model.step[a][b] for a, b in zip(y, y[1:]))

    best = max(itertools.product((0, 1), repeat=n), key=score)
    assert H.decode(model, page) == [bool(v) for v in best]


def test_held_out_accuracy():
    held = H.labelled_pages(200, seed=99)
    right = [a == b for p, labels in held for a, b in zip(H.decode(H.default_model(), p), labels)]
    assert np.mean(right) > 0.99


def article(page):
    """The given pages' article, by their own markup."""
    part = page[page.index("<article>") + 9:page.index("</article>")]
    part = part.replace("<b>", "").replace("</b>", "").replace("<br>", " ")
    found = (" ".join(html.unescape(x).split()) for x in re.split(r"</?p>|</?h1>", part))
    return "\n\n".join(x for x in found if x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_given_pages(spark):
    rows = H.extract(spark.read.parquet(f"{SF}/pages.parquet").withColumn("src", __import__("pyspark").sql.functions.col("html"))).collect()
    assert len(rows) == 250 and all(r.text == article(r.src) for r in rows)


def test_other_layouts_and_odd_rows(spark):
    p1, p2 = "Une phrase assez longue pour un article, avec plusieurs mots.", "Second paragraph of the story, also long enough to read."
    shell = ('<div id="cookie-consent"><p>We use cookies. Accept all of them, please, before reading.</p></div><div class="navbar"><ul>'
             '<li><a href=/>Home</a><li><a href=/x>World news</a></ul></div>{}<div class="sidebar widget"><h3>More</h3><ul><li><a href=/r>'
             'Related story one</a></ul></div><div class="comments"><p>I disagree with this article, as I often do.</p></div>'
             '<form class=newsletter><p>Sign up for our letters today.</p></form><footer><p>&copy; Example. All rights reserved.</p></footer>')
    bodies = ["<article><h1>Title here</h1><p>{}</p><p>{}</p></article>", '<div class="post-content"><h1>Title here</h1><p>{}<p>{}</div>',
              '<main><h1>Title here</h1><p>{}</p><div class="ad">Buy this now. It is a good thing to have.</div><p>{}</p></main>']
    pages = [(k, shell.format(b.format(p1, p2)), "c") for k, b in enumerate(bodies)]
    pages += [(10, None, "c"), (11, "", "c"), (12, "<" * 5000, "c"), (None, pages[0][1], "c"), (0, pages[0][1], "c"),
              (13, "<article><p>" + "Long text of it. " * 60000 + "</p></article>", "c")]
    df = spark.createDataFrame(pages, "page_id long, html string, text string")
    got = H.extract(df).collect()
    want = f"Title here\n\n{p1}\n\n{p2}"
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(pages) and by[0] == by[1] == by[2] == by[None] == want
    assert by[10] == by[11] == "" and len(by[13]) == 17 * 60000 - 1
    assert H.extract(df.limit(0)).count() == 0


def test_broken_quotes_are_not_text():
    got = H.blocks("""<p title='it's'>one</p><p class="lead>two</p><p class="x">three</p><p title="a > b">four</p><p data-x="<i>">five</p>"""
                   """<p class="lead>He said "hi" to us</p><p a=b"c>six</p><p>a < b and 3<4</p><svg><p>seven</p></ >x<!doctype>""")
    assert [b.text for b in got] == ["one", "two", "three", "four", "five", 'He said "hi" to us', "six", "a < b and 3<4", "seven", "x"]
    assert "name:text" not in got[1].path and [b.text for b in H.blocks("a<!-- b <p>c")] == ["a"]


@pytest.mark.parametrize("broken", ["<a ", '<a x=">" ', "<a x='", "<!", "<svg>", "<h1>", "</script ", "<div class='", "</p><div>",
                                    "<td><table><h1><th></th>"])
@pytest.mark.parametrize("around", [("", ""), ("<script></script ", ">")])
def test_broken_markup_takes_linear_time(broken, around):
    page = around[0] + broken * (3_000_000 // len(broken)) + around[1]
    start = time.process_time()
    H.blocks(page)
    assert time.process_time() - start < 10


@pytest.mark.parametrize("shell", [
    '<nav><a href=/>Home</a> <a href=/b>World</a></nav>{}<footer>&copy; Example</footer>', "{}",
    '<div id="cookie-consent"><p>We use cookies. Accept all of them, please, before reading.</p></div><ul class="navbar"><li><a href=/>Home'
    '</a><li><a href=/x>World news</a></ul>{}<div class="sidebar"><h3>More</h3><ul><li><a href=/r>Related story one</a></ul></div>'
    '<div class="comments"><p>I disagree with this article, as I often do.</p></div><footer><p>All rights reserved.</p></footer>'])
@pytest.mark.parametrize("opening,closing", [
    ("", ""), ("<div>", "</div>"), ('<div id="wrapper">', "</div>"), ('<div class="container">', "</div>"),
    ('<div class="news-item">', "</div>"), ('<div class="qx7"><div class=zz>', "</div></div>"), ('<section id="s1">', "</section>"),
    ("<table><tr><td>", "</td></tr></table>"), ('<div class="entry">', "</div>"), ("<article>", "</article>")])
def test_articles_in_neutral_wrappers(shell, opening, closing):
    p1, p2 = "Une phrase assez longue pour un article, avec plusieurs mots.", "Second paragraph of the story, also long enough to read."
    page = shell.format(f"{opening}<h1>Title here</h1><p>{p1}</p><p>{p2}</p>{closing}")
    assert H.main_text(H.default_model(), page) == f"Title here\n\n{p1}\n\n{p2}"
    assert H.main_text(H.default_model(), f'<div class="row">{page}</div>') == f"Title here\n\n{p1}\n\n{p2}"
