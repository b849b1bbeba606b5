import re

import numpy as np
import pytest

from gristmill.llm import extract


def page(k, paragraphs, head="nav", body="article"):
    text = "".join(f"<p>Paragraph {k} {i}, it says more, and then some more &amp; it ends.</p>" for i in range(paragraphs))
    return (
        f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<{head}><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></{head}>"
        f"<div class='ad'>Buy this now.</div><{body}><h1>Title {k}</h1>{text}</{body}><footer>&copy; Site {k}</footer></body></html>"
    )


@pytest.fixture(scope="module")
def model():
    return extract.fit([page(k, 2 + k % 7) for k in range(40)])


def test_article_of_unseen_pages(model):
    for k, n in ((100, 1), (101, 5), (102, 30)):
        want = [f"Title {k}", *[f"Paragraph {k} {i}, it says more, and then some more & it ends." for i in range(n)]]
        assert extract.main_text(model, page(k, n)).split("\n") == want


def test_page_without_marking_elements(model):
    html = page(7, 6, head="div", body="div").replace("<div><ul>", "<div class='menu'><ul>")
    html = html.replace("<footer>", "<div id='comments'><p>Nice one, says a reader, and thanks.</p></div><footer>")
    text = extract.main_text(model, html)
    assert "Paragraph 7 5" in text and "reader" not in text and "Buy" not in text and "Site" not in text and "Home" not in text


def test_no_kept_element_under_a_dropped_one(model):
    tree = extract.nodes(extract.parse(page(3, 4)))
    keep = extract.decode(tree, extract.margins(model, extract.features(tree)))
    assert all(keep[x.parent.number] for x in tree if x.parent is not None and keep[x.number])


def test_blocks():
    def texts(html):
        root = extract.parse(html)
        return extract.blocks(root, np.ones(len(extract.nodes(root)), bool))

    assert texts("<div><p>a  <b>b</b>\n c<p>d<br>e&nbsp;f</div>g") == ["a b c", "d", "e f", "g"]
    assert texts("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>") == ["x", "y", "z", "w"]
    assert texts("<div>1 &lt; 2 <!-- no --><script>if (a<b) {}</script>end<p title='a>b'>q</p>") == ["1 < 2 end", "q"]
    assert texts("text <b>only") == ["text only"]
    assert texts("<p>cut <a hre") == ["cut"]


def test_batches_equal_single_pages(model):
    trees = [extract.nodes(extract.parse(page(k, k))) for k in range(1, 6)]
    together = extract.features(*trees)
    assert (together == np.concatenate([extract.features(t) for t in trees])).all()


def test_boosting_learns_a_rule():
    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = extract.boost(x, y)
    assert ((extract.margins(m, x) > 0) == (y > 0.5)).mean() > 0.97


def test_query_rows(spark, model):
    rows = [(1, "u", page(1, 3)), (1, "u", page(1, 3)), (None, None, None), (2, "", ""), (3, "x", "<p>" * 3000 + "deep"), (4, "y", "plain words " * 40_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text", "1 AS n")
    got = extract.extract(table, model).collect()
    assert len(got) == len(rows)
    assert all(r.text is not None for r in got)
    assert {r.text for r in got if r.page_id in (None, 2)} == {""}
    assert len({r.text for r in got if r.page_id == 1}) == 1
    assert extract.training_pages(table) and len(extract.training_pages(table, most_pages=1)) == 1
    assert extract.extract(table.limit(0), extract.fit([])).count() == 0


def test_without_marked_pages_all_text_stays():
    m = extract.fit(["<p>one</p>"])
    assert re.split("\n", extract.main_text(m, "<div>a<p>b</p></div>")) == ["a", "b"]
