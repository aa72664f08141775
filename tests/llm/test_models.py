"""Toxicity and HTML blocks: held-out accuracy, places, and odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendwell.llm import html_blocks, lstm, toxicity
from mendwell.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_toxicity(spark):
    found = QUERIES["op4_toxicity"](spark, SF)
    rows = found.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").select("doc_id", "held_out", "score", "predicted", "toxic").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    out = [r for r in rows if r.held_out and r.toxic is not None]
    toxic = [r.predicted for r in out if r.toxic]
    clean = [r.predicted for r in out if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("mor", "tan", "pel", "vir") for b in ("go", "lu", "sa", "ti", "no")]
    docs, labels = [], []
    for k in range(900):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(1, 6))]
        toxic = k % 4 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] += " vileness"
        docs.append((k, ". ".join(sentences)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_sentences_are_located(spark, labelled):
    docs, labels = labelled
    scorer = toxicity.train(docs, labels)
    rows = [(1, "pelgo tansa. You VILENESS!\nmorlu", "x"), (None, None, None), (2, "", None), (2, " .!\n", None), (3, "pelgo " * 40_000, "y"), (1, "pelgo tansa. You VILENESS!\nmorlu", "x")]
    found = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string, score string"), scorer).collect()
    assert [r.predicted for r in found] == [1, 0, 0, 0, 0, 1]
    assert [found[0].text[s.start : s.start + s.length] for s in found[0].toxic_sentences] == [" You VILENESS"]
    assert found[0] == found[5] and found[1].score == found[2].score == found[3].score == 0


def test_nothing_held_out_is_learnt(spark, labelled):
    docs, labels = labelled
    before = toxicity.train(docs, labels)
    held = toxicity.is_held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, turned.unionAll(turned.limit(0))).weights == before.weights


def test_no_or_odd_labels(spark, labelled):
    docs, labels = labelled
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.scored(docs.limit(5), none).filter("predicted = 1").count() == 0
    odd = labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (5, 0), (5, 1), (10_000, 1)], "doc_id long, toxic int"))
    assert toxicity.train(docs, odd).bias < 0
    assert toxicity.scored(docs.limit(0), none).collect() == []


# --- HTML ---


def test_gradients():
    rng = np.random.default_rng(0)
    net = lstm.Labeller({k: v.astype(float) for k, v in lstm.Labeller.fresh(4, 3, 1).weights.items()})
    x, y, lengths = rng.standard_normal((5, 3, 4)), rng.integers(0, 2, (5, 3)).astype(float), np.array([5, 3, 1])
    mask = np.arange(5)[:, None] < lengths

    def loss():
        p = lstm.sigmoid(net.forward(x, lengths))
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / mask.sum()

    for name, grad in net.gradients(x, y, lengths).items():
        for at in list(np.ndindex(grad.shape))[:6]:
            kept = net.weights[name][at]
            net.weights[name][at] = kept + 1e-5
            above = loss()
            net.weights[name][at] = kept - 1e-5
            below = loss()
            net.weights[name][at] = kept
            assert abs((above - below) / 2e-5 - grad[at]) < 1e-5


def test_padding_changes_nothing():
    net = lstm.Labeller.fresh(4, 3, 1)
    x = np.random.default_rng(0).standard_normal((6, 2, 4)).astype(np.float32)
    both = net.forward(x, np.array([6, 4]))
    alone = net.forward(x[:4, 1:], np.array([4]))
    assert np.allclose(both[:4, 1], alone[:, 0], atol=1e-6)


def blocks(page):
    return [(b.path[-1][0] if b.path else None, b.text) for b in html_blocks.blocks_of(page)]


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (None, []),
        ("", []),
        ("just text &amp; more", [(None, "just text & more")]),
        ("<p>a<p>b<br>c&nbsp; d</p>e", [("p", "a"), ("p", "b c d"), (None, "e")]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", [("li", "a"), ("li", "b"), ("li", "c")]),
        ("<p><b>a <i>b</p><p>c</i></b>", [("p", "a b"), ("p", "c")]),
        ('<script>var t="<p>no</p>";</script><style>p{}</style><p>x<!-- <p>y --></p><!-- open', [("p", "x")]),
        ('<p title="a > b">x < y && z <</p>', [("p", "x < y && z <")]),
        ("<script>never closed <p>x</p>", []),
        ("<table><tr><td>a<td>b<tr><td>c</table>", [("td", "a"), ("td", "b"), ("td", "c")]),
        ("</div></p><p>x</section>y</p>", [("p", "x"), ("p", "y")]),
        ("<DIV><P>x</P>&#233;&lt;b&gt;</DIV>", [("p", "x"), ("div", "é<b>")]),
    ],
)
def test_blocks(page, expected):
    assert blocks(page) == expected


ODD = """<html><head><title>T</title></head><body class="home"><header><div class="logo">Site name</div><ul><li><a href=x>Home</a></ul></header>
<div class="cookie-notice"><p>We use cookies and other things to make this site work better for everybody.</p></div>
{open}<h1>Real title</h1><p>First paragraph with &amp; several words of text that is long enough to be a paragraph.
<p>Second one, <a href=z>with a link</a> and more words that go on.<ul><li>point one of list<li>point two</ul>
<form><label>Email</label><input></form><div class="comments"><h3>Comments</h3><div class="comment"><p>I think this is a very good article and I like it a lot.</p></div></div>{close}
<aside><h3>Related</h3><ul><li><a>Other</a></ul></aside><footer>Copyright 2020</footer></body></html>"""


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = QUERIES["op1_html_text"](spark, SF)
    assert found.columns[:4] == ["page_id", "url", "text", "n_chars"]
    rows = {r.page_id: r for r in found.collect()}
    assert len(rows) == pages.count()
    # Held-out pages of the table: what stands in their article element.
    for r in pages.orderBy(F.xxhash64(F.lit(9), "page_id")).limit(400).collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        assert rows[r.page_id].text == "\n".join(text for _, text in blocks(inner))
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text)


def test_other_layouts_and_odd_rows(spark):
    labeller = html_blocks.train(spark.read.parquet(f"{SF}/pages.parquet"))
    layouts = [('<div id="content"><div class="post">', "</div></div>"), ("<main><article>", "</article></main>"), ('<section class="article-body">', "</section>")]
    rows = [(k, ODD.format(open=a, close=b)) for k, (a, b) in enumerate(layouts)] + [(7, None), (8, ""), (None, "<p></p>"), (0, ODD.format(open=layouts[0][0], close=layouts[0][1]))]
    rows.append((9, "<article>" + "<p>word and word and word again</p>" * 20_000 + "</article>"))
    found = html_blocks.extracted(spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("clash")), labeller).collect()
    text = "Real title\nFirst paragraph with & several words of text that is long enough to be a paragraph.\nSecond one, with a link and more words that go on.\npoint one of list\npoint two"
    assert [r.text for r in found[:7]] == [text] * 3 + ["", "", "", text]
    assert found[7].n_blocks == 20_000
    assert html_blocks.extracted(spark.createDataFrame([], "page_id long, html string"), labeller).collect() == []


def test_learning_from_nothing(spark):
    labeller = html_blocks.train(spark.createDataFrame([(1, None)], "page_id long, html string"))
    assert html_blocks.extracted(spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string"), labeller).count() == 1


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ('<p>one <svg class="i"/> two</p><p>three</p>', ["one two", "three"]),
        ("<p>a</p><svg><path d='M'><title>t</title></svg><p>b</p>", ["a", "b"]),
        ("<p>a <svg> x <p>b</p>", ["a x", "b"]),
        ("<object data=x /><p>c</p><canvas/>d<iframe src='y'/><p>e</p>", ["c", "d", "e"]),
        ("<object><p>other</p></object><noscript><p>turn on</p></noscript><iframe>in</iframe><p>c</p>", ["c"]),
        ("<canvas><p>d</p>", ["d"]),
        ("<p>a</p><script>var a = '<p>x</p>'", ["a"]),
        ("<svg>" * 30_000 + "<p>end</p>", ["end"]),
    ],
)
def test_elements_that_are_left_out_take_nothing_else_along(page, texts):
    assert [b.text for b in html_blocks.blocks_of(page)] == texts


def test_long_pages_are_taught_to_their_end(monkeypatch):
    seen = []
    monkeypatch.setattr(html_blocks, "variants", lambda pages: [(b, [k >= 900 for k in range(len(b))]) for b in pages])
    monkeypatch.setattr(html_blocks.Labeller, "train", lambda self, batches, *rest: seen.extend(batches))
    html_blocks.fit(["".join(f"<p>block {k}</p>" for k in range(1_000))])
    assert sum(y.sum() for _, y, _ in seen) == 100 and max(max(lengths) for *_, lengths in seen) == html_blocks.RUN
