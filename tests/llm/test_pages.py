import random

import numpy as np
import pytest

from gridloom.llm import html_text, url_filter


def page(blocks, tail="</body></html>"):
    body = "".join(f"<p>{b}" for b in blocks)
    return ('<!DOCTYPE html><html><head><meta charset="utf-8"><title>Title here</title><style>p{margin:0}</style><script>var t="</p><article>";</script></head><body>'
            '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="cookie-notice">We use cookies, please agree.</div>'
            f'<!-- <p>not this --><article><header><h1>Head &amp; line</h1></header>{body}<aside>Aside text</aside><form><p>Your name<input></form>'
            '<section id="comments"><p>First! A reader comment that is long enough to look like content.</p></section></article>'
            f'<div class="side sidebar">More to read elsewhere</div><footer>&copy; us</footer>{tail}')


def test_articles(prose):
    r = random.Random(1)
    for n in (1, 2, 5, 40):
        texts = [prose(r.randrange(10 ** 6), r.choice([1, 3, 30, 200])) for _ in range(n)]
        assert html_text.main_text(page(texts)) == "\n\n".join(["Head & line", *texts])
        assert html_text.main_text(page(texts, "")) == "\n\n".join(["Head & line", *texts])


def soup(r, prose, landmark, wrapper):
    """A page with its true text: (html, text). Menus, adverts, comments and a footer stand around blocks of an article."""
    names = iter(range(10 ** 6))
    div = lambda inner, name=None: f'<div class="{name or f"c{next(names)}"}">{inner}</div>'                                # noqa: E731
    links = lambda n: "<ul>" + "".join(f'<li><a href="/{i}">{prose(r.randrange(10 ** 6), 2)}</a>' for i in range(n)) + "</ul>"       # noqa: E731
    blocks = [prose(r.randrange(10 ** 6), n) for n in (60, *(r.choice([40, 60, 90, 150]) for _ in range(r.randrange(3, 9))))]
    blocks[r.randrange(1, len(blocks)):0] = [prose(r.randrange(10 ** 6), 2)]                                            # a short paragraph among long ones
    body = "".join(f"<p>{b}</p>" for b in blocks)
    advert = div(f"<p>{prose(r.randrange(10 ** 6), 40)}</p>", "ad-slot")
    comments = f'<section id="comments">{"".join(f"<p>{prose(r.randrange(10 ** 6), 50)}</p>" for _ in range(3))}</section>'
    inner = {"article": f"<article>{body}</article>", "post": f'<article class="post social">{body}</article>', "main": f"<main>{body}</main>", "div": div(body),
             "articles": f'<article>{body[:body.index("</p>") + 4]}</article><article>{body[body.index("</p>") + 4:]}</article>'}[landmark]
    page = div(links(40)) + div(f"{prose(1, 2)} &middot; {prose(2, 1)}") + advert + inner + comments + div(links(30), "related") + div(links(30)) + div(f"<span>&copy; {prose(3, 2)}</span>")
    return f"<html><body>{div(page, wrapper)}</body></html>", "\n\n".join(blocks)


WRAPPERS = ["site", "site has-sidebar", "no-sidebar", "page sidebar-right", "nav-wrapper comments-open"]


@pytest.mark.parametrize("landmark", ["article", "post", "main", "div", "articles"])
def test_generated_pages(prose, landmark):
    r = random.Random(landmark)
    for wrapper in WRAPPERS:
        for _ in range(8):
            html, text = soup(r, prose, landmark, wrapper)
            assert html_text.main_text(html) == text, (wrapper, html)


def test_the_threshold_decides_where_no_element_does(prose, monkeypatch):
    r = random.Random(7)
    pages = [soup(r, prose, "div", w) for w in WRAPPERS for _ in range(5)]
    assert all(html_text.main_text(html) == text for html, text in pages)
    monkeypatch.setattr(html_text, "threshold", lambda values: -1.0)
    assert sum(html_text.main_text(html) == text for html, text in pages) < len(pages) / 2


def test_class_names():
    says = html_text.sounds_like
    assert says("sidebar-left") == says("x ad") == says("share-bar") == "aside" and says("comment-list") == says("nav comments") == "comment"
    assert says("has-sidebar") is says("no-sidebar") is says("comments-open") is says("badge header2") is says("") is None


def test_a_page_of_nothing_else_is_kept_whole():
    assert html_text.main_text('<div class="comments"><p>one</p><p>two</p></div>') == "one\n\ntwo"


def test_an_advert_longer_than_the_article():
    html = f'<div class="ad">{"buy this now " * 20}</div><article><h1>Short</h1><p>Yes.</article>'
    assert html_text.main_text(html) == "Short\n\nYes."


def test_without_an_article_element(prose):
    a, b = prose(1, 80), prose(2, 60)
    html = f'<body><div id="nav"><a href="/">Home</a> <a href="/x">Other</a></div><div><p>{a}</p><p>No.</p><p>{b}</p></div><div><ul><li><a href="/1">One</a><li><a href="/2">Two</a></ul></div></body>'
    text = html_text.main_text(html)
    assert a in text and b in text and "Home" not in text and "One" not in text


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), (" \n ", ""), ("plain   text", "plain text"), ("<article>a&nbsp;b &lt;c&gt; &#233;<br>d<p>e</article>", "a b <c> é d\n\ne"), ("<article><p><b>x<br><p>y</article>", "x\n\ny"),
    ("<article><div>a<div>b</div>c</div></article>", "a\n\nb\n\nc"), ("<main><p>a<script>b</script>c</main>", "a\n\nc"), ("<article>x<span class=ad>buy</span> y</article>", "x y"),
    ("<article><p hidden>no</p><p>yes</article>", "yes"), ("<script>x", ""), ("<article>a<!-- never closed <p>b", "a"), ("<article><ul><li>one<li>two</ul></article>", "one\n\ntwo")])
def test_small_pages(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("html", ["<" * 50_000, "<!" * 30_000, "<p>" * 30_000, "<a " * 30_000, "</" * 30_000, "<!--" * 30_000, "<b>" * 30_000, "<div><p>x" * 5_000, "<!-- >" * 30_000,
                                  "<a b='" * 20_000, "<td><p>x" * 5_000, "<script>" * 20_000, "&#x41" * 30_000, "<a " * 20_000 + ">"])
def test_hostile_pages_end(html):
    html_text.main_text(html)


def test_smoothing_and_threshold():
    flat = np.full(9, 5.0)
    assert np.allclose(html_text.smoothed(flat), 5.0) and html_text.smoothed(np.array([7.0])).tolist() == [7.0]
    assert 2 < html_text.threshold(np.array([1.0, 2, 1, 90, 100, 95])) < 90


def test_extracted_rows(spark):
    rows = [(1, "u", page(["Some text here."])), (1, "u", page(["Some text here."])), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, HTML string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_text.extracted(df).collect()), key=str)
    want = "Head & line\n\nSome text here."
    assert got == sorted([(1, "u", want, len(want))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_text.extracted(df.limit(0)).collect() == []


RULES = url_filter.RULES


def ruled(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    best = max(((len(h + p), h + p, says) for says, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules(spark):
    r = random.Random(5)
    parts = ["http", "://", "/", "?", "#", "com", ".", "www", "example", "net", "en", "fr", "es", "/en/", "EXAMPLE", "É", "x", ""]
    urls = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(1500)]
    urls += [f"https://{h}{p}" for h in ("example.com", "www.example.com", "a.www.example.com", "notexample.com", "net", "x.NET", "com", "examplecom") for p in ("", "/", "/en", "/en/1", "/fr/2?x", "/es/#a")]
    urls += [None, "", urls[0]]
    rows = url_filter.judge(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, URL string")).collect()
    assert len(rows) == len(urls)
    for x in rows:
        host, path, rule, says = ruled(urls[x.page_id])
        assert (x.host, x.path, x.rule) == (host, path, rule) and x.verdict in ("allow", "block") and says in (None, x.verdict), urls[x.page_id]


def test_templates_by_labels(spark):
    rows, labels = [], []
    for i in range(600):
        part, bad = [("spam", True), ("news", False), ("open", None)][i % 3]
        rows.append((i, f"http://h.org/{part}/{i * 37}/page-{i}.html"))
        if bad is not None and i % 2:
            labels.append((i, bad))
    rows += [(9000, "http://other.org/a/b"), (9001, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {x.page_id: x for x in url_filter.judge(df, [], spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert all(got[i].verdict == ("block" if i % 3 == 0 else "allow") for i in range(600)) and got[9000].verdict == got[9001].verdict == "allow"
    assert {got[i].template for i in range(0, 600, 3)} == {"/spam/{n}/page-{n}.html"} and got[2].template == "/open/{n}/page-{n}.html"
    assert got[2].purity == pytest.approx(((100 + 5 * 0.5) / (200 + 5)), abs=0.02)                # that of the host
    assert url_filter.judge(df.limit(0)).collect() == []


def test_a_hot_blocked_host_judges_no_other(spark):
    rows = [(i, f"http://casino-win.example.com/en/{i}") for i in range(300)] + [(300 + i, f"http://h{i % 7}.org/{'abc'[i % 3]}/{i}") for i in range(570)]
    rows += [(900 + i, f"http://www.example.com/en/{i}") for i in range(30)]
    labels = [(i, True) for i in range(300)] + [(300, True), (303, True), (900, False)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for got in (url_filter.judge(df), url_filter.judge(df, [], spark.createDataFrame(labels, "page_id long, bad boolean"))):
        verdicts = {x.page_id: x.verdict for x in got.collect()}
        assert [i for i, _ in rows if verdicts[i] == "block"] == list(range(300))


def test_unlabelled_branches_follow_their_host(spark):
    """Without labels of its own a branch has the purity of its nearest labelled ancestor on the same host, and of no other host."""
    rows, labels = [], []
    for host, bad in (("bad.org", True), ("good.org", False)):
        for i in range(40):
            rows += [(len(rows), f"http://{host}/a/{i}"), (len(rows) + 1, f"http://{host}/b/c/{i}"), (len(rows) + 2, f"http://{host}/b/d/{i}")]
            labels += [(len(rows) - 3, bad), (len(rows) - 2, bad)]
    rows += [(len(rows) + i, f"http://other.org/a/{i}") for i in range(40)]
    got = {x.page_id: x for x in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), [], spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    verdicts = {host: {got[i].verdict for i, u in rows if f"//{host}/" in u} for host in ("bad.org", "good.org", "other.org")}
    assert verdicts == {"bad.org": {"block"}, "good.org": {"allow"}, "other.org": {"allow"}}
    at = {u.split("//")[1].rsplit("/", 1)[0]: got[i].purity for i, u in rows}
    assert at["other.org/a"] < 0.55 and at["bad.org/b/d"] > at["other.org/a"] > at["good.org/b/d"]


def test_templates_tell_held_out_labels(spark):
    """Half of what the rules say is hidden; the templates tell it from the other half."""
    import pathlib
    folder = pathlib.Path("/root/testdata/sf0.1/pages.parquet")
    if not folder.exists():
        pytest.skip("the test tables are not here")
    pages = spark.read.parquet(str(folder))
    said = {x.page_id: x.verdict == "block" for x in url_filter.judge(pages).where("rule is not null").collect()}
    known = [(i, bad) for i, bad in said.items() if i % 2 == 0]
    got = {x.page_id: x.verdict == "block" for x in url_filter.judge(pages, [], spark.createDataFrame(known, "page_id long, bad boolean")).collect()}
    hidden = [i for i in said if i % 2]
    right = sum(got[i] == said[i] for i in hidden) / len(hidden)
    most = max(sum(said[i] for i in hidden), sum(not said[i] for i in hidden)) / len(hidden)
    clean = [i for i in hidden if not said[i]]
    print(f"held out {len(hidden)}: right {right:.3f}, one verdict for all {most:.3f}")
    assert right > most and sum(got[i] for i in clean) <= 0.05 * len(clean)
