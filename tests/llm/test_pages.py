"""Pages that browsers read and parsers stumble on, and wrappers that carry the result."""

import random

import pytest

from claimloom.llm import html_extract as H

PAGE = "page_id long, url string, html string"


def text_of(page):
    return " ".join(t for _, t, _ in H._kept(H.parse(page)[1]))


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p data-x=5">Hello</p><p>World', "Hello World"),
        ("<p class=it's>a</p>b", "a b"),
        ("<!-->x<!--->y<!-- c --!>z", "xyz"),
        ('<p title="a>b">q', "q"),
        ('<p class="foo>text</p>tail', "text tail"),
        ("a </> b </3 c> d <?x?> e < f <unclosed", "a b d e < f"),
        ("<svg><svg></svg>no</svg>yes <svg> more", "yes more"),
        ("<script>a<p></script >b<script/>c</script>d<style>e", "b d"),
        ("<title>a<b>c</title>d", "d"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("&am<b>p;</b> &amp;lt; caf&eacute", "&amp; &lt; café"),
        ("<form><input><article>a<form>b</form></article>c</form>", "a"),
        ('<p data-class="ad" data-id="menu">kept</p><p class="ad">gone', "kept"),
        ('<article><p class="related-work">a</p><p id=notice>b</p><section class="search-results-explained">c</section><div class="share-price">d</div></article>', "a b c d"),
        ('<article>a<div class="ad">b</div><aside>c</aside><article class="comment">d</article><div role=navigation>e</div></article>f', "a"),
    ],
)
def test_pages_as_browsers_read_them(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(
    "page, n",
    [
        ("<div>" * 10000 + "x" + "</div>" * 10000, 1),
        ("<p>" * 30000 + "x", 1),
        ("<div>" + "<p>a</p>" * 20000 + "</div>", 20000),
        ("<b>" * 50000 + "<p>x</p>" * 1000 + "</b>" * 50000, 1000),
        ("<ul>" + "<div>" * 5000 + "<li>a</li>" * 5000, 5000),
        ('<a href="' * 20000, 0),
        ("<svg>" * 20000 + "x", 1),
    ],
)
def test_deep_and_wide_pages(page, n):
    assert len(H.parse(page)[1]) == n
    other = page.replace("<p>", "<p><div>z</div>", 3) + "<div>t</div>"
    assert len(H.aligned(other, page)[0]) >= n


def test_wide_lists_match_piece_by_piece():
    rng = random.Random(3)

    def wide(n):
        return "<div>" + "".join("<section>" + "<p>a</p>" * rng.randint(0, 5) + rng.choice(["", "<div>b<ul><li>c</ul></div>", "<table><tr><td>x</table>"]) + "</section>" for _ in range(n)) + "</div>"

    a, b = H.parse(wide(400))[0], H.parse(wide(380))[0]
    exact = list(H.Matcher().pairs(a, b))
    for m in (H.Matcher(table_cells=256), H.Matcher(page_cells=1000), H.Matcher(page_cells=0)):
        pairs = list(m.pairs(a, b))
        assert all(x.tag == y.tag for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        of = {id(x): y for x, y in pairs}
        assert all(of[id(k)] in of[id(x)].kids for x, _ in pairs for k in x.kids if id(k) in of)
        assert 0.5 * len(exact) < len(pairs) <= len(exact)


def story(n, k):
    """A page without an article element and without telling names; what its host repeats or only links is no story."""
    links = "".join(f"<li><a href=/{n}/{k}/{j}>Link {k} {j}</a></li>" for j in range(2 + k % 4))
    return f"<body><div><p>Host {n} line</p><ul>{links}</ul></div><div><h1>Title {k}</h1><p>Story {k} <a href=/x>of</a> host.<ul><li><a href=/y>Alone {k}</a></ul><p>It goes on {k}.</div><div><p>All rights kept {n}</p><p>Made in {n}</p></div></body>"


def test_wrapper_carries_pages_without_an_article(spark):
    rows = [(100 * n + k, f"https://h{n}.org/{k}", story(n, k)) for n in (2, 3, 5, 9, 30) for k in range(n)]
    d = spark.createDataFrame(rows, PAGE)
    want = {100 * n + k: f"Title {k} Story {k} of host. Alone {k} It goes on {k}." for n in (2, 3, 5, 9, 30) for k in range(n)}
    assert {r.page_id: r.text for r in H.extract(d).collect()} == want
    without = {r.page_id: r.text for r in H.extract(d, min_share=1e9).collect()}
    assert all(without[k] != want[k] and "Link" in without[k] and "Host" in without[k] for k in want)


def test_more_layouts_than_leaders(spark, monkeypatch):
    monkeypatch.setattr(H, "LEADERS", 2)
    odd = ["ol li", "dl dt", "table tr", "pre", "blockquote section", "h2"]
    page = lambda j, k: "<body>" + "".join(f"<{t}>" for t in odd[j].split() * (j + 1)) + f"Same {j}</{odd[j].split()[0]}><p>Story {k}</p></body>"
    rows = [(10 * j + k, "https://one.org/", page(j, k)) for j in range(6) for k in range(3)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {10 * j + k: f"Story {k}" for j in range(6) for k in range(3)}


def test_rare_shapes_find_each_other(spark, monkeypatch):
    """Layouts beyond the most frequent shapes whose pages differ in shape, so that each shape has one page."""
    monkeypatch.setattr(H, "LEADERS", 2)
    page = lambda t, k: f"<body>{f'<{t}>' * 6}Same {t}{f'</{t}>' * 6}<h{k + 1}>Story {t} {k}</h{k + 1}></body>"
    rows = [(10 * j + k, "https://one.org/", page(t, k)) for j, t in enumerate(("section", "blockquote", "pre", "dl", "figure")) for k in range(3)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {10 * j + k: f"Story {t} {k}" for j, t in enumerate(("section", "blockquote", "pre", "dl", "figure")) for k in range(3)}


def test_columns_of_any_name(spark):
    names = ["_host", "_id", "_seed", "blocks", "_template", "_layout", "_shape", "votes", "a.b", "text", "n_chars"]
    d = spark.createDataFrame([(k, f"https://one.org/{k}", story(1, k), *[k] * len(names)) for k in range(3)], f"{PAGE}, " + ", ".join(f"`{n}` int" for n in names))
    got = H.extract(d)
    assert got.columns == ["page_id", "url", *names[:-2], "text", "n_chars"]
    assert all(r["_host"] == r["a.b"] == r["blocks"] == r.page_id and r.text.startswith("Title") for r in got.collect())


def test_hot_host_of_copies(spark):
    rows = [(k, "https://one.org/", story(1, k % 7)) for k in range(300)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {k: f"Title {k % 7} Story {k % 7} of host. Alone {k % 7} It goes on {k % 7}." for k in range(300)}


def test_wide_lists_match_as_a_whole():
    """Lists too wide for a table, pages with many different lists, and nested ones match as without any bound."""
    rng = random.Random(11)
    part = lambda: "<section>" + "".join(rng.choice(["<p>a</p>", "<ul><li>b</ul>", "<h2>c</h2>", "<ul><li>b<li><p>d</p></ul>"]) for _ in range(rng.randint(0, 4))) + "</section>"
    for _ in range(30):
        one = [part() for _ in range(rng.randint(5, 40))]
        two = [p if rng.random() < 0.7 else part() for p in rng.choices([part(), ""], k=rng.randint(0, 6)) + one[rng.randint(0, 9) :]]
        a, b = (H.parse(f"<div>{part()}<div>{''.join(x)}</div>{part()}</div><p>e</p>")[0] for x in (one, two))
        exact = [(x.number, y.number) for x, y in H.Matcher(10**9, 10**9).pairs(a, b)]
        for bounds in ((4, 10**9), (10**9, 50), (10**9, 0), (60, 500)):
            m = H.Matcher(*bounds)
            assert [(x.number, y.number) for x, y in m.pairs(a, b)] == exact and H.Matcher(*bounds).score(a, b) == len(exact)


def test_wide_pages_lose_no_template(spark):
    """300 lines on every page, with 300 paragraphs that stand elsewhere among them on each: all lines are template, no more."""
    line = lambda j: "<section>" + "".join("<ul></ul>" if j >> b & 1 else "<ol></ol>" for b in range(9)) + f"<h2>Line {j}</h2></section>"
    story = lambda k, j: f"Story {k} {j} " + "of a page with many lines " * 9 + "ends."
    own = lambda k, j: [story(k, 5 * j + i) for i in range(5)] if 40 * k <= j < 40 * k + 60 else []
    page = lambda k: "".join("".join(f"<div><p>{s}</p></div>" for s in own(k, j)) + line(j) for j in range(300))
    pages = [(k, f"https://one.org/{k}", f"<html><body><div>{page(k)}</div></body></html>") for k in range(6)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, PAGE)).collect()}
    assert got == {k: " ".join(s for j in range(300) for s in own(k, j)) for k in range(6)}


def test_formulas_are_text():
    assert text_of("<p>As <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x</annotation></math> says") == "As x=2 says"
