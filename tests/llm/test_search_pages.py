"""Cover-tree search, personal data, page extraction and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from sparkselect.llm import cover_search, html_extract, personal_data
from tests.conftest import SF

VECTORS = "vec_id long, embedding array<float>, label int, `key` long, n int, dim int"


def search_truth(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (qi, q) in enumerate(ok):
        if qi % 20 == 0:
            best = sorted((-int(q @ v), i) for b, (i, v) in enumerate(ok) if a != b and len(v) == len(q))[:k]
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_refuses_products_beyond_64_bits(spark):
    big = lambda top: spark.createDataFrame([(i, [float(top - i) / 64, float(top - 2 * i) / 64]) for i in range(40)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, cover_search.op2_frame(big(2 ** 30)).select("query_id", "rank", "vec_id", "score").collect()))
    vectors = [(2 ** 30 - i, 2 ** 30 - 2 * i) for i in range(40)]
    want = [(q, r + 1, i, -s) for q in (0, 20) for r, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(vectors[q], vectors[i], strict=True)), i) for i in range(40) if i != q)[:20])]
    assert got == want
    with pytest.raises(Exception, match="64-bit"):
        cover_search.op2_frame(big(2 ** 31)).collect()


def test_search_edges(spark):
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(5, 8))
    rows = [(i, [float(x) for x in (base[i % 5] + rnd.normal(size=8) * 0.05).astype(np.float32)], 1, 1, 1, 1) for i in range(400)]
    rows += [(400 + i, rows[0][1], 1, 1, 1, 1) for i in range(60)]  # a common vector: ties
    rows += [(500, None, 1, 1, 1, 1), (520, [1.0, None], 1, 1, 1, 1), (540, [float("nan")] * 8, 1, 1, 1, 1), (560, [float("inf")] * 8, 1, 1, 1, 1), (580, [], 1, 1, 1, 1),
             (None, rows[1][1], 1, 1, 1, 1), (600, [0.0] * 8, None, None, None, None), (620, [0.5, 0.25], 1, 1, 1, 1), (621, [0.5, 0.5], 1, 1, 1, 1)]
    rows += [rows[20], rows[20], rows[21]]  # repeated rows
    got = cover_search.op2_frame(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got)) == search_truth(rows)
    assert cover_search.op2_frame(spark.createDataFrame([], VECTORS)).collect() == []
    assert cover_search.op2_frame(spark.createDataFrame([(0, [1.0], 1, 1, 1, 1)], VECTORS)).collect() == []


def test_trees_cover_and_prune():
    rnd = np.random.default_rng(9)
    centers = rnd.normal(size=(30, 16)) * 60
    points = np.floor(centers[rnd.integers(0, 30, 3000)] + rnd.normal(size=(3000, 16)))
    tree = cover_search.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(3000))
    for i in range(len(tree.low)):
        d = np.linalg.norm(tree.points[tree.low[i]:tree.high[i]] - tree.centers[i], axis=1)
        assert d.max() <= tree.radius[i] + 1e-4
        if tree.last[i]:
            kids = range(tree.first[i], tree.last[i])
            assert [tree.low[kids[0]], tree.high[kids[-1]]] == [tree.low[i], tree.high[i]]
            assert max(tree.radius[c] for c in kids) <= tree.radius[i] / cover_search.BASE + 1e-4
    queries = cover_search.CoverTree(points[::20])
    best = cover_search.Best(150, 21, np.full(150, cover_search.NONE))
    taken = cover_search.dual_search(queries, tree, tree.order.astype(np.int64), best)
    assert taken < 0.5 * 150 * 3000, "clustered data must be pruned"
    whole = (queries.points @ points.T).astype(np.int64)
    for j in range(150):
        assert best.id[j].tolist() == np.lexsort((np.arange(3000), -whole[j]))[:21].tolist()


def test_search_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_search, "BLOCK", 64)
    monkeypatch.setattr(cover_search, "GROUP", 8)
    rnd = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rnd.normal(size=6).astype(np.float32)], 1, 1, 1, 1) for i in range(500)]
    got = cover_search.op2_frame(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(map(tuple, got)) == search_truth(rows)


PII = ["mail bob.smith+x@mail.example.com, or x@y", "ip 10.0.0.1 and 300.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111111111111112", "call +1 (456) 555-2186 now +12", None, "",
       "é\U0001d518 a@b.co é", "+1 234 567 8901 4111-1111-1111-1111 9.9.9.9", "a@b@c.de d@e.f.g.", "5105105105105100", "0001.2.3.4"]


def luhn_ok(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x // 10 + x % 10
    return t % 10 == 0


def base_truth(t):
    t = t or ""
    out = [(m.start(), 0, f"email:{m.start()}:{m.end()}") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, f"ip:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn_ok(d):
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    out += [(m.start(), 3, f"phone:{m.start()}:{m.end()}") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [x[2] for x in sorted(out)]


def test_personal_data_base(make_docs, no_docs):
    docs = make_docs(PII)
    got = {r.doc_id: r for r in personal_data.find_spans(docs, personal_data.Trees()).collect()}
    for i, t in enumerate(PII):
        want = base_truth(t)
        r = got[i + 1]
        assert r.spans == ",".join(want) and r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in personal_data.BASE]
    assert personal_data.op6_frame(no_docs).collect() == []


def test_personal_data_model(make_docs):
    rnd = random.Random(7)
    words = "the of and lorem ipsum dolor amet magna".split()
    plain = lambda: " ".join(rnd.choice(words) for _ in range(30))

    def card():
        d = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return next(d + x for x in "0123456789" if luhn_ok(d + x))

    made = [lambda: f"u{rnd.randrange(999)}@mail{rnd.randrange(9)}.example.com", lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)), card,
            lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(10**4):04d}", lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)),
            lambda: f'password={rnd.randrange(16**18):018x}']
    texts = [f"{plain()} {made[i % 6]()} {plain()}" for i in range(600)]
    fitted = personal_data.fit(make_docs(texts))
    assert len(fitted.trees) == personal_data.TREES
    found = lambda t: personal_data.added_spans([t], [personal_data.base_spans(t)], fitted)[0]
    for text, kind in (("call 555-123-4567 now", "phone"), ("ssn 123-45-6789 ok", "ssn"), ('token = "3f9a8b7c6d5e4f3a2b1c" x', "secret"), ("to bob [at] example [dot] com x", "email")):
        assert [s[1] for s in found(text)] == [kind], text
    clean = ["on 2024-01-02 at 10:30", "see foo-bar-baz-2020-report-final here", "version 1.2.3 of it", "order 1234567890123456 done", plain()]
    assert all(not found(t) for t in clean)
    docs = make_docs(["a b@c.de f +1 (456) 555-2186", None, "clean text"])
    out = personal_data.redact(docs, fitted).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["a [EMAIL] f [PHONE]", None, "clean text"] and out[0].lang == "en"


def private_texts(n=300):
    rnd = random.Random(8)
    words = "the of and lorem ipsum dolor amet magna".split()
    plain = lambda: " ".join(rnd.choice(words) for _ in range(20))
    made = [lambda: f"u{rnd.randrange(999)}@mail{rnd.randrange(9)}.example.com", lambda: f"+1 ({rnd.randrange(200, 999)}) 555-{rnd.randrange(10**4):04d}",
            lambda: "AKIA" + "".join(rnd.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16)), lambda: f"password={rnd.randrange(16**18):018x}"]
    return [f"{plain()} {made[i % 4]()} {plain()}" for i in range(n)]


def test_personal_data_copies_do_not_fill_the_sample(make_docs):
    texts = private_texts()
    alone = personal_data.fit(make_docs(texts), sample_rows=1000)
    copies = personal_data.fit(make_docs(texts + [texts[3]] * 150), sample_rows=1000)  # a third of the rows
    assert len(alone.trees) == personal_data.TREES and alone.least == copies.least
    for a, b in zip((*alone.steps, *alone.trees[-1]), (*copies.steps, *copies.trees[-1]), strict=True):
        assert np.array_equal(a, b)


def test_long_secrets_are_redacted_whole(make_docs):
    fitted = personal_data.fit(make_docs(private_texts()))
    rnd = random.Random(12)
    url = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    some = lambda n, chars=url: "".join(rnd.choice(chars) for _ in range(n))
    secrets = [some(600), some(2000), some(600, "0123456789abcdef"), some(600, url[:62] + "+/"), f"eyJ{some(33)}.eyJ{some(500)}.{some(43)}"]
    texts = [f"so {hint}{x} and then" for hint in ("token: ", "password=", "") for x in secrets]
    out = personal_data.redact(make_docs(texts), fitted).orderBy("doc_id").collect()
    assert [r.text for r in out] == [f"so {hint}[SECRET] and then" for hint in ("token: ", "password=", "") for _ in secrets]
    signed = f"https://files.example.com/a/report.pdf?expires=1700000000&signature={some(400, url[:62] + '+/')}"
    assert [r.text for r in personal_data.redact(make_docs([f"the token: {signed} x"]), fitted).collect()] == ["the token: [SECRET] x"]
    clean = ["see " + "/".join(["lorem", "ipsum"] * 40 + ["2020"]) + " x", "-" * 300 + "1 x", "_".join(["dolor", "amet"] * 50 + ["10"])]
    assert [r.text for r in personal_data.redact(make_docs(clean), fitted).orderBy("doc_id").collect()] == clean


def test_base_spans_within_a_secret_leave_its_rest_redacted():
    text = "x" * 30 + "10.0.0.1" + "y" * 30
    base = personal_data.base_spans(text)
    assert personal_data._outside_of(0, len(text), base) == [(0, 30), (38, 68)]
    assert personal_data._outside_of(28, 40, base) == []


def test_isotonic_is_increasing():
    m, p = personal_data.isotonic(np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(p) >= 0).all() and (np.diff(m) > 0).all() and p[-1] == 1


FRAME = ('<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
         '<div class="cookie-notice"><p>We use cookies and more words here.</p></div><div class="wrap2"><div class="story">{0}</div><div class="sidebar"><p>Side text of some length, really.</p></div></div>'
         '<section id="comments"><p>Nice post, thanks a lot for this.</p></section><footer>&copy; me</footer></body></html>')


@pytest.mark.parametrize(("html", "text"), [
    (FRAME.format("<h2>Title &amp; more</h2><p>First  para\n with <b>bold</b> and <a href=x>link</a>.<p>Second&nbsp;one &#233; here, long enough.<ul><li>i1<li>i2</ul><form><input><p>Sign up</p></form>"),
     "Title & more\nFirst para with bold and link.\nSecond one é here, long enough.\ni1\ni2"),
    ("<p>a<br>b</p><script>x</script>c", "a b\nc"), ("", ""), (None, ""), ("plain", "plain"), ("<article><p>cut off te", "cut off te"),
    ("<ARTICLE><P>Upper</P><!-- hidden <p>no</p> --><p title='a>b'>x &lt; y</p></ARTICLE>", "Upper\nx < y"), ("<p class=", ""), ("a < b and c > d", "a < b and c > d"),
])
def test_page_text(html, text):
    assert html_extract.Page(html or "").extract(None) == text


def test_host_consensus(spark):
    many = FRAME.format("<p>" + "Long main text, with words. " * 20 + "</p>")
    # on this page an unnamed block outweighs the article: only the host's other pages tell
    odd = FRAME.format("<p>Short main.</p>").replace('<div class="sidebar">', '<div class="x"><p>' + "Other text of the page. " * 60 + '</p></div><div class="sidebar">')
    rows = [(i, f"http://a.example/p{i}", many, 1, "p") for i in range(5)] + [(9, "https://A.example:80/odd?x#y", odd, 1, "p"), (10, None, "<p>no url</p>", 1, "p"), (None, "http://b.example", None, 1, "p"), (10, None, "<p>no url</p>", 1, "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, path string")
    assert html_extract.Page(odd).extract(None) != "Short main."
    want = [(r[0], r[1], t, len(t)) for r, t in zip(rows, [("Long main text, with words. " * 20).strip()] * 5 + ["Short main.", "no url", "", "no url"], strict=True)]
    assert sorted(map(tuple, html_extract.op10_frame(pages).collect()), key=str) == sorted(want, key=str)
    assert html_extract.op10_frame(pages.limit(0)).collect() == []
    paths = {r.host: r.path for r in html_extract.host_paths(pages).collect()}
    assert paths["a.example"] == "body>div.wrap>div.story"


LONG = "A long text with many words. " * 100


@pytest.mark.parametrize(("inner", "text"), [
    (f"<article><h1>Title</h1><p>Lead.</p><div class=body><p>{LONG}</p></div></article>", f"Title\nLead.\n{LONG.strip()}"),
    (f"<div class=page><h1>Title</h1><p>Lead.</p><div class=body><p>{LONG}</p></div></div>", f"Title\nLead.\n{LONG.strip()}"),
    (f"<article><div class=body><p>{LONG}</p></div><table><tr><td>{'cell ' * 40}<td>b</table></article>", f"{LONG.strip()}\n{('cell ' * 40).strip()}\nb"),
    (f"<article><div><div><p>{LONG}</p></div><p>Second.</p></div><ul><li><a href=x>source</a></ul></article>", f"{LONG.strip()}\nSecond.\nsource"),
    (f"<div class=m><a href=1>One</a> <a href=2>Two</a></div><div class=b><p>{LONG}</p></div>", LONG.strip()),
])
def test_nothing_of_an_article_is_left_beside_its_body(inner, text):
    page = f"<html><body><nav><a href=/>Home</a></nav>{inner}<footer>me</footer></body></html>"
    assert html_extract.Page(page).extract(None) == text


@pytest.mark.parametrize(("inner", "kept"), [
    ("<section id=related-work><h2>Related work</h2><p>Prose on it.</p></section>", "Related work\nProse on it."),
    ("<h2 id=popular-methods>Popular methods</h2>", "Popular methods"), ("<h2 id=comments>Comments</h2>", "Comments"),
    ("<div id=search-results><p>What the search found.</p></div>", "What the search found."),
    ("<p class=alert>Mind the gap.</p>", "Mind the gap."), ("<p>A <span id=notice>b</span> c.</p>", "A b c."),
    ("<section id=reviews-of-the-method><p>They say.</p></section>", "They say."),
    ("<section id=related-work><p><a href=1>One more</a> and <a href=2>another one</a></p></section>", ""),
    ("<div id=search-results><input name=q><p>Find it</p><button>Go</button></div>", ""),
    ("<div class=related-posts><p>Read on here.</p></div>", ""), ("<section id=comments><p>Nice.</p></section>", ""),
    ("<p class=cookie-notice>We use cookies.</p>", ""), ("<div class='share-buttons'>Share it</div>", ""), ("<div class=sidebar><p>Side.</p></div>", ""),
])
@pytest.mark.parametrize("frame", ["<article><p>First.</p>{}<p>Last.</p></article>", "<div class=story><p>First.</p>{}<p>Last.</p></div>", "<p>First.</p>{}<p>Last.</p>"])
def test_names_that_mention_a_page_part(frame, inner, kept):
    page = f"<body><nav>n</nav>{frame.format(inner)}</body>"
    assert html_extract.Page(page).extract(None) == "\n".join(x for x in ("First.", kept, "Last.") if x)


def test_title_and_lead_stay_on_a_host_whose_other_pages_have_none(spark):
    page = "<body><nav>n</nav><div class=page><div class=sidebar>s</div>{}<div class=body><p>" + LONG + "</p></div></div></body>"
    html = [page.format("")] * 3 + [page.format("<h1>Title</h1><p>Lead.</p><table><tr><td>cell</table>")]
    pages = spark.createDataFrame([(i, "http://c.example/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.op10_frame(pages).collect()}
    assert got[0] == LONG.strip() and got[3] == f"Title\nLead.\ncell\n{LONG.strip()}"


def test_host_paths_joined_by_shuffle(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    a = sorted(map(tuple, html_extract.op10_frame(pages).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", -1)
    assert sorted(map(tuple, html_extract.op10_frame(pages).collect())) == a


def test_pipeline_stages(spark, odd_docs, no_docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "personal_data", "source_mixing", "best_fit_packing"]
    for docs in (odd_docs, no_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        before = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, docs, SF)
            assert after.columns == before.columns and after.dtypes == before.dtypes
            docs = spark.createDataFrame(after.collect(), after.schema)
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert packed.where("piece = 0").count() == docs.count()
    assert corpus_pipeline.run(spark, SF).count() > 0
