"""The article of a page without a model: blocks by text and link density, and the best run of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import publication_date

#: Elements of which nothing is read, and elements that end a block.
DROPPED = ["script", "style", "noscript", "template", "svg", "iframe", "head", "nav", "footer", "aside", "form", "button", "select", "table"]
BLOCKS = ["p", "div", "section", "article", "main", "header", "h[1-6]", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "hr", "br", "tr", "td", "th", "body", "html", "center", "address", "details", "summary", *DROPPED]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
#: What a character of a link counts against one of text, and what every block costs.
LINK_COST, BLOCK_COST = 3, 20
#: The length that an article is cut to, and the score of its evidence row.
MOST, SCORE = 3500, 0.55
_SPACE = r"[ \t\n\r\f]"
#: A dropped element, from its tag to its first end tag: one pattern, since a pass for each costs more than all the rest.
DROP = "(?is)<(?:" + "|".join(rf"{tag}(?:{_SPACE}[^>]*)?>.*?</{tag}{_SPACE}*>" for tag in DROPPED) + ")"


def _marked(html: Column) -> Column:
    """Text in which \\x01 ends a block and \\x02 and \\x03 enclose links, without any tags."""
    h = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), "\x01\x02\x03", ""), "(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, DROP, "\x01")
    h = F.regexp_replace(F.regexp_replace(h, rf"(?i)<a(?:{_SPACE}[^>]*)?>", "\x02"), rf"(?i)</a{_SPACE}*>", "\x03")
    h = F.regexp_replace(h, rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:[ \t\n\r\f/][^>]*)?>", "\x01")
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, F.regexp_replace(h, "<[^>]*>", ""))


def _blocks(html: Column) -> Column:
    """array<struct<t, plain>>: the blocks with text, and how many of their characters are outside of links."""
    flat = lambda x: F.trim(F.regexp_replace(x, f"{_SPACE}+", " "))
    each = F.transform(F.split(_marked(html), "\x01"), lambda b: F.struct(flat(F.translate(b, "\x02\x03", "")).alias("t"), F.length(flat(F.regexp_replace(b, "\x02[^\x03]*\x03?", " "))).alias("plain")))
    return F.filter(each, lambda b: b["t"] != "")


def _linked(b: Column) -> Column:
    return F.greatest(F.length(b["t"]) - b["plain"], F.lit(0))


def article_text(html: Column | str, most: int = MOST) -> Column:
    """The lines of the run of blocks with the greatest sum of gains, the first of equals, cut at `most`; empty where no run gains.

    A block gains its characters outside of links less LINK_COST times those inside and BLOCK_COST, so that paragraphs win
    and menus lose, and short lines pass between paragraphs only. One pass keeps the best run that ends at each block and
    the best of all; in that run, blocks that are mostly links are left out. A null page is empty.
    """
    page = F.col(html) if isinstance(html, str) else html
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("at", "sum", "start", "best", "first", "last")])

    def step(s: Column, b: Column) -> Column:
        gain = b["plain"] - LINK_COST * _linked(b) - BLOCK_COST
        new = s["sum"] <= 0
        total, start, at = F.when(new, gain).otherwise(s["sum"] + gain), F.when(new, s["at"]).otherwise(s["start"]), s["at"]
        better = total > s["best"]
        pick = lambda a, c, name: F.when(better, a).otherwise(s[c]).cast("long").alias(name)
        return F.struct((at + 1).cast("long").alias("at"), total.cast("long").alias("sum"), start.cast("long").alias("start"), pick(total, "best", "best"), pick(start, "first", "first"), pick(at + 1, "last", "last"))

    def text(blocks: Column) -> Column:
        run = F.aggregate(blocks, none, step)
        chosen = F.filter(F.slice(blocks, (run["first"] + 1).cast("int"), (run["last"] - run["first"]).cast("int")), lambda b: _linked(b) <= b["plain"])
        return F.substring(F.array_join(F.transform(chosen, lambda b: b["t"]), "\n"), 1, most)

    return F.transform(F.array(_blocks(page)), text)[0]


def article_rows(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """keep, text, url, source, title, score, type, published_at, scrape_method: an evidence row of each page with an article."""
    u = F.coalesce(F.col(url), F.lit(""))
    r = pages.select(*keep, article_text(html).alias("text"), u.alias("url"), u.alias("source"), u.alias("title"), F.lit(SCORE).alias("score"), F.lit("scraping").alias("type"), publication_date(F.coalesce(F.col(html), F.lit(""))).alias("published_at"), F.lit("article").alias("scrape_method"))
    return r.where("text <> ''")
