"""Articles by density, against the same rule in plain Python."""

import random
import re

from claimloom import queries_rest as Q
from claimloom.operators import articles as R
from claimloom.operators.articles import article_rows, article_text

SPACE = r"[ \t\n\r\f]"


def plain(page):
    """Blocks, their gains, and the best run by trying all of them."""
    h = re.sub("(?s)<!--.*?-->", " ", re.sub("[\x01-\x03]", "", page or ""))
    at, out = 0, []
    while m := re.compile(rf"(?is)<({'|'.join(R.DROPPED)})(?=>|{SPACE})").search(h, at):  # one element after the other
        open_end = h.find(">", m.end())
        end = re.compile(rf"(?is)</{m[1]}{SPACE}*>").search(h, open_end + 1) if open_end >= 0 else None
        out.append(h[at : m.start()] + ("\x01" if end else h[m.start() : m.end()]))
        at = end.end() if end else m.end()
    h = "".join(out) + h[at:]
    h = re.sub(rf"(?i)</a{SPACE}*>", "\x03", re.sub(rf"(?i)<a(?:{SPACE}[^>]*)?>", "\x02", h))
    h = re.sub("<[^>]*>", "", re.sub(rf"(?i)</?(?:{'|'.join(R.BLOCKS)})(?:[ \t\n\r\f/][^>]*)?>", "\x01", h))
    for a, b in R.ENTITIES:
        h = h.replace(a, b)
    flat = lambda x: re.sub(f"{SPACE}+", " ", x).strip(" ")
    blocks = [(flat(re.sub("[\x02\x03]", "", b)), len(flat(re.sub("\x02[^\x03]*\x03?", " ", b)))) for b in h.split("\x01")]
    blocks = [(t, p, max(len(t) - p, 0)) for t, p in blocks if t]
    gains = [p - R.LINK_COST * linked - R.BLOCK_COST for _, p, linked in blocks]
    best, first, last = 0, 0, 0
    for b in range(1, len(gains) + 1):
        ends = [(sum(gains[a:b]), a) for a in range(b)]
        top = max(x for x, _ in ends)
        # of runs of equal sums that end here, the one that the rule keeps: it starts anew after a sum of 0
        if top > best:
            best, first, last = top, max(a for x, a in ends if x == top), b
    return "\n".join(t for t, p, linked in blocks[first:last] if linked <= p)[: R.MOST]


def page(rng):
    word = lambda n: "".join(rng.choice("abc é&") for _ in range(n))
    parts = []
    for _ in range(rng.randint(0, 25)):
        kind, n = rng.random(), rng.randint(0, 90)
        body = word(n) if kind < 0.5 else f'<A href="/x">{word(n)}</a> {word(n // 3)}' if kind < 0.8 else f"<b>{word(n)}<br/>{word(n)}&amp;lt;"
        parts.append(rng.choice(["<p>{}</p>", "<div class=x>{}</div>", "<li>{}", "<nav>{}</nav>", "<h2 >{}</h2>", "{}", "<table><tr><td>{}</table>", "<script>{}</script>", "<!-- {} -->", "<a>{}", "<header>{}</header>"]).format(body))
    return rng.choice(["", "<html><head><title>t</title></head><body>"]) + "\n".join(parts)


def test_articles_against_plain(spark, sf):
    rng = random.Random(9)
    pages = [None, "", "<p>", "text without tags that is long enough", "<p>" + "x" * 9000, "<div>" * 3000 + "deep text of some length here" * 3, *[page(rng) for _ in range(400)]]
    pages += [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    d = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    got = [r.t for r in d.select("k", article_text("html").alias("t")).orderBy("k").collect()]
    assert got == [plain(p) for p in pages] and sum(map(bool, got)) > 250


def test_menus_lose_and_paragraphs_win(spark):
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Some section {k}</a>" for k in range(8)) + "</ul>"
    story = "<h1>A short title</h1><p>" + "One long sentence of the story goes here. " * 4 + "</p><p>See <a href=/x>this</a>. " + "And another one follows it. " * 5 + "</p>"
    d = spark.createDataFrame([(1, "https://h.org/a", f"<div>{menu}</div>{story}<ul><li><a href=/y>{'Read more of it ' * 3}</a></ul>{menu}<p>Foot</p>"), (2, None, f"<body>{menu}"), (3, "u", None)], "id int, url string, html string")
    got = article_rows(d, ["id"]).collect()
    assert [(r.id, r.url, r.source, r.title, r.score, r.type, r.published_at) for r in got] == [(1, "https://h.org/a", "https://h.org/a", "https://h.org/a", 0.55, "scraping", "")]
    lines = got[0].text.split("\n")
    assert len(lines) in (2, 3) and lines[-1].startswith("See this. And") and not any("section" in x or "Read more" in x for x in lines)


def test_no_shuffle(spark, sf):
    assert "Exchange" not in Q.src16(spark, sf)._jdf.queryExecution().executedPlan().toString()
