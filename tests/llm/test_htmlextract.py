import html
import re
import time

import pytest

from botlens.llm import htmlextract as H

SF = "/root/testdata/sf0.01"


def article_of(page):
    """Brute force for the generated pages: the one article element, block by block."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = [re.sub(r"<[^>]+>", "", re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))


def test_generated_pages_exactly(spark):
    from botlens.llm import queries
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.queries()["op9_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == article_of(pages[r.page_id]) and r.n_chars == len(r.text)


def test_without_article_markup_the_weights_still_find_the_text(spark):
    """Held-out check: weights from labelled pages, applied to the pages with their labels removed."""
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    weights = H.learn(rows)
    right = 0
    pages = [r.html for r in rows.collect()]
    for page in pages:
        bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
        right += H.extract(bare, weights) == article_of(page)
    assert right >= 0.95 * len(pages)


def test_boilerplate_inside_and_around():
    prose = "This is a sentence of the article with quite a few words in it."
    page = f"""<html><head><title>T &amp; more words of a title</title><style>p {{}}</style></head><body>
      <header><h2>Site name</h2></header><div id="cookie-notice">We use cookies, do you accept them all?</div>
      <div class="menu"><a href="/a">Home</a> <a href="/b">News</a></div>
      <div class="content"><h1>The headline &lt;1&gt;</h1><p>{prose}  {prose}</p>
      <div class="advert">Buy one, get one</div><ul><li>First point of some length</li><li>Second <b>poi</b>nt of it</li></ul>
      <form><label>Your mail</label><input name=x></form><script>var x = "<p>no</p>";</script><!-- <p>no</p> -->
      <p>{prose}<br>after&nbsp;break</p></div>
      <div class="comments"><p>{prose}</p><p>I liked it very much, thanks for sharing this</p></div>
      <aside>See also these other pages</aside><footer>&copy; 2020 all rights reserved</footer></body></html>"""
    assert H.extract(page, {}) == "\n".join([
        "The headline <1>", f"{prose} {prose}", "First point of some length", "Second point of it", f"{prose} after break"])


def test_long_boxes_inside_an_article_cut_nothing():
    """Short lead, long box, body, long box, short end; weights as learned on pages without such boxes."""
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    for tag in ("article", "main"):
        for box in ('div class="newsletter"', "aside", 'section class="related"'):
            page = f"""<body><nav>{words("nav", 30)}</nav><{tag}><h1>{words("head", 8)}</h1><p>{words("lead", 30)}</p>
              <{box}><p>{words("box", 45)}</p><ul><li>{words("item", 60)}</li></ul></{box.split()[0]}><p>{words("body", 500)}</p>
              <{box}><p>{words("other", 60)}</p></{box.split()[0]}><p>{words("end", 40)}</p></{tag}>
              <footer>{words("foot", 50)}</footer></body>"""
            want = "\n".join([words("head", 8), words("lead", 30), words("body", 500), words("end", 40)])
            assert H.extract(page, {("word", "outside"): -1.0, ("word", "content"): 1.0}) == want
            assert H.extract(page, {}) == want


def test_frames_named_after_boilerplate_keep_their_content():
    prose = "This is a sentence of the article with quite a few words in it."
    page = f"""<body class="menu-open"><div class="page has-sidebar"><div class="sidebar-left">Links to other things</div>
      <div class="post-content"><div class="article-header"><h1>Headline</h1></div><p>{prose}</p></div>
      <div class="ad-container">An advert with some words in it</div><div class="post-comments"><p>{prose}</p></div>
      <div class="site-footer">All the usual words of a footer</div></div></body>"""
    assert H.extract(page, {}) == f"Headline\n{prose}"


def test_nulls_empty_and_broken(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "plain words only", None), (4, "<p>open <b>tag", "u"), (4, "<p>open <b>tag", "u"),
            (None, "<div class='ad'>ad words</div>", "u"), (5, "<article><p>" + "word " * 50_000, "u"), (6, "<" * 2000, "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id, r.text) for r in H.main_text(df).collect()), key=repr)
    want = [(1, ""), (2, ""), (3, "plain words only"), (4, "open tag"), (4, "open tag"), (None, ""),
            (5, " ".join(["word"] * 50_000)), (6, "<" * 2000)]
    assert got == sorted(want, key=repr)
    assert H.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("page", ["<script " * 130_000, "<a " * 350_000, "<p title='x " * 80_000, "<" * 1_000_000,
                                  "<ul>" + "<li><b>" * 140_000, "<div>" * 100_000 + "</nav>" * 80_000, "<!--" * 250_000,
                                  "<a b=" * 200_000, "<p a" + " " * 1_000_000, "<textarea>" * 100_000, "</" * 500_000,
                                  '<a href="' * 110_000, "<title>x</title " * 60_000, "&" * 1_000_000])
def test_malformed_pages_take_a_linear_pass(page):
    started = time.perf_counter()
    H.extract(page, {})
    assert time.perf_counter() - started < 5


def test_attributes_and_open_ends():
    text = lambda page: H.extract(page, {})
    words = "one two three four five six"
    assert text(f"<p title=it's>{words}</p>") == words
    assert text(f"<p title='it>s' class=x/>{words}</p>") == words
    assert text(f'<p title="a > b">{words}</p>') == words
    assert text(f"<p a = 'x' b c=>{words}</p>") == words
    assert text(f"<div class=nav>menu</div><p id=''>{words}") == words
    assert text(f"<p>{words}</p><!-- never closed {words}") == words
    assert text(f"<p>{words} 1 < 2</p>") == f"{words} 1 < 2"
    assert text(f"<p>{words}</p><p unfinished {words}") == words
    assert text(f"<p title='open>{words}</p>") == words
