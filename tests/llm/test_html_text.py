"""Main texts of pages: layouts, odd pages, tags, decoding."""

import pytest

from touchline.llm import html_text as H

SF = "/root/testdata/sf0.01"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head><body>
<header class="site-header"><div>My site</div></header><div class="cookie-notice"><p>We use cookies, accept them all please.</p></div>
<nav><ul><li><a href="/a">Home</a><li><a href='/b?x="1">About</a></ul></nav><!-- <p>gone</p> -->%s<h1>The&nbsp;title</h1><p>A long paragraph of text, with many words,
   and <b>sentences</b>. It goes on &amp; on.<br>Next line.<p>Another one here, quite long as well, so there is something to read.<div class="ad-box"><p>Buy now, cheap things.</p></div>
<ul><li>First point, said fully.<li>Second point, said fully.</ul>%s<section id="comments"><p>Nice post, I liked it very much, thanks.</p></section><form><label>Mail</label><input></form>
<aside><p>Recent posts, of all kinds.</p></aside><footer><p>&copy; 2020</p></footer></body></html>"""
TEXT = "The title\nA long paragraph of text, with many words, and sentences. It goes on & on.\nNext line.\nAnother one here, quite long as well, so there is something to read.\nFirst point, said fully.\nSecond point, said fully."


@pytest.fixture(scope="module")
def model(spark):
    return H.train(H.pages(spark.read.parquet(f"{SF}/pages.parquet")))


@pytest.mark.parametrize("frame", [("<article>", "</article>"), ("<main><div>", "</div></main>"), ('<div class="content">', "</div>"), ('<div id="wrap"><div>', "</div></div>")])
def test_layouts(model, frame):
    assert H.extract(PAGE % frame, model) == TEXT


def test_pages(spark):
    import re
    from html import unescape

    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = H.op10_html_text(spark, SF).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", source[r["page_id"]], re.S)
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", article[1])] if article else []
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_odd_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags &lt;at all"), (3, "u", "no tags &lt;at all"), (None, "u", "<p>one<p>two</div></b><br>three <i>four"), (5, "u", "<script>var a = 1"), (6, "u", "<p " * 50),
            (7, "u", "<div>" * 3000 + "deep"), (8, "u", "<!-- never closed <p>x</p>"), (9, "u", "<p>" + "word " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "a long, b string, c string, d int").toDF("page_id", "url", "html", "HTML")
    got = H.extracted(H.pages(df), model).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[3] == "no tags <at all" and by[None] == "one\ntwo\nthree four" and by[1] == by[2] == by[5] == by[8] == "" and by[7] == "deep"
    assert H.extracted(H.pages(df.limit(0)), model).count() == 0
    assert H.extract("<p>x</p>", H.train(H.pages(df.limit(0)))) in ("", "x")


def test_no_text_is_lost_by_its_tag(model):
    """What stands in the article stays, whatever its tag; scripts, styles and form fields go."""
    body = "<p>" + "Some words of an article about nothing much at all. " * 12 + "</p>"
    inside = "<p>press <button>go</button> now, x <math>a+b</math> y, <object>seen</object> <noscript>plain</noscript> <svg><text>drawn</text></svg></p><script>no()</script><style>p{}</style><select><option>pick</option></select>"
    page = f"<html><body><nav><a href=x>Home</a><a href=y>News</a></nav><article><h1>Title here</h1>{body}{inside}{body}</article><footer>Imprint</footer></body></html>"
    text = H.extract(page, model)
    assert all(w in text for w in ("press go now", "a+b", "seen", "plain", "drawn")) and "no()" not in text and "pick" not in text


def test_decoding_does_not_contradict_itself(model):
    import numpy as np

    nodes = H.nodes_of(H.parse(PAGE % ("<article>", "</article>")))
    rng = np.random.default_rng(0)
    for _ in range(50):
        odds, weight = rng.normal(size=len(nodes)), rng.random(len(nodes))
        keep = H.decode(nodes, odds, weight)
        assert all(keep[v.parent.order] or not keep[k] for k, v in enumerate(nodes) if v.parent is not None)
