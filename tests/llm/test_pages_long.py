"""Deep and long pages in seconds, article text of rare elements, and the vote against a plain loop."""

import random
import time
from collections import Counter, defaultdict

import pytest

from sparkselect.llm import html_extract


@pytest.mark.parametrize("html", [
    "<div class='a b'>" * 100_000 + "<p>deep text</p>", "<p>deep text</p>" + "</b></div></section>" * 50_000, "<p>deep text" + "<i><b>" * 60_000,
    "<nav>" + "<div class=content><p>menu</p></div>" * 20_000 + "</nav><p>deep text</p>", "<div class=comments>" + "<div class=post>x</div>" * 20_000 + "</div><p>deep text</p>",
    "<p>deep text</p>" + "<canvas>" * 50_000, "<ul>" + "<li>deep text" * 1 + "<ul>" * 20_000, "<table><tr><td>deep text" + "<td><table>" * 20_000])
def test_long_pages_take_seconds(html):
    start = time.time()
    page = html_extract.Page(html)
    assert "deep text" in page.extract(page.path(page.choice()))
    assert time.time() - start < 30


def test_article_text_of_rare_elements_stays():
    html = ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title here</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be a number that we look at.</p>"
            "<object data=f.bin><p>The fallback of an object in the text.</p></object><p><label>A label outside of forms</label> says more.</p>"
            "<form><label>Mail</label><input></form></article><footer>foot</footer></body></html>")
    assert html_extract.Page(html).extract(None) == "Title here\nLet x=2 be a number that we look at.\nThe fallback of an object in the text.\nA label outside of forms says more."


def test_votes_and_second_extraction_equal_a_plain_loop(spark):
    rnd = random.Random(61)
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = []
    for i in range(120):
        host = rnd.choice(["a.org", "b.org", "A.org", None])
        shape = rnd.choice(["<div class='wrap w{0}'><nav>x</nav><div class='text-{0}'>{1}</div></div>", "<main><article>{1}</article></main>", "<div class=page><header>h</header>{1}</div>"])
        body = "".join(f"<p>{words(rnd.randint(3, 20))}</p>" for _ in range(rnd.randint(0, 4)))
        rows.append((i, None if host is None else f"https://{host}/p{i}", shape.format(i % 7, body), "x"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    votes, score = defaultdict(Counter), defaultdict(float)
    for _, url, html, _ in rows:
        page = html_extract.Page(html)
        w = page.weights()
        if w[0] > 0:
            at = (html_extract.host_of(url), page.path(page.choice()))
            votes[at[0]][at[1]] += 1
            score[at] += w[page.choice()]
    best = {h: max(c, key=lambda p: (c[p], round(score[h, p], 3), -len(p))) for h, c in votes.items()}
    assert {r.host: r.path for r in html_extract.host_paths(pages).collect()} == best and len(best) == 3
    want = [(i, url, html_extract.Page(html).extract(best.get(html_extract.host_of(url)))) for i, url, html, _ in rows]
    assert sorted((r.page_id, r.url, r.text) for r in html_extract.op10_frame(pages).collect()) == sorted(want)
