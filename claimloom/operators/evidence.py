"""Loose retrieval rows to evidence rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp, date_in_text, first_filled, published_at, to_float

# Names under which providers give a field, in order.
ALIASES = {
    "text": ["text", "content", "snippet", "body", "description", "summary", "abstract"],
    "title": ["title", "headline", "name"],
    "snippet": ["snippet", "description", "summary", "content", "body"],
    "url": ["url", "source_url", "link", "href", "permalink"],
    "source": ["source", "source_name", "publisher", "provider", "site_name"],
    "date": ["published_at", "published", "date", "pub_date", "timestamp", "time"],
    "lang": ["lang", "language"],
    "score": ["score", "relevance", "confidence"],
}


def pick(rows: DataFrame, field: str) -> Column:
    """The first filled column of a field's names; null if there is none."""
    there = [F.col(c) for c in ALIASES[field] if c in rows.columns]
    return first_filled(*there) if there else F.lit(None).cast("string")


def normalize(rows: DataFrame, keep: list[str], default_type: str = "web_search", most: int = 4000) -> DataFrame:
    """keep, text, url, title, source, score, type, published_at, date_source, lang. Rows without any text go.

    The text is cut first, so that what is shuffled later stays narrow.
    """
    title, snippet = pick(rows, "title"), pick(rows, "snippet")
    both = F.trim(F.concat_ws(" ", title, snippet))
    text = F.coalesce(pick(rows, "text"), F.when(both != "", both))
    r = rows.select(*keep, text.alias("_text"), title.alias("_title"), snippet.alias("_snippet"), pick(rows, "url").alias("_url"), pick(rows, "source").alias("_source"), pick(rows, "date").alias("_date"), pick(rows, "lang").alias("_lang"), F.coalesce(*[to_float(c) for c in ALIASES["score"] if c in rows.columns], F.lit(0.5)).alias("_score"), (F.coalesce("type", F.lit(default_type)) if "type" in rows.columns else F.lit(default_type)).alias("type"))
    found = date_in_text(F.concat_ws(" ", "_title", "_snippet", "_text"))
    iso = published_at(F.coalesce("_date", found))
    source = F.coalesce("_source", "_title", F.lit("unknown"))
    r = r.where(F.col("_text").isNotNull()).withColumn("published_at", iso)
    how = F.when(F.col("published_at") == "", "none").when(F.col("_date").isNotNull(), "explicit").otherwise("inferred")
    return r.select(*keep, F.substring("_text", 1, most).alias("text"), F.coalesce("_url", F.lit("")).alias("url"), F.coalesce("_title", source).alias("title"), source.alias("source"), clamp(F.col("_score")).alias("score"), "type", "published_at", how.alias("date_source"), F.coalesce("_lang", F.lit("")).alias("lang"))


def publication_date(html: Column | str) -> Column:
    """The date that a page names: meta tags by priority, <time>, JSON-LD, then the head of its text; ISO or empty."""
    h = F.col(html) if isinstance(html, str) else html
    names = ["article:published_time", "og:published_time", "publication_date", "publish-date", "pubdate", "date", "dc.date", "article:modified_time"]
    cut = lambda p: F.when((x := F.regexp_extract(h, p, 1)) != "", x)
    meta = [cut(rf"(?is)<meta[^>]*(?:property|name|itemprop)=[\"']{n}[\"'][^>]*content=[\"']([^\"']+)[\"']") for n in names]
    other = [cut(r"(?is)<time[^>]*datetime=[\"']([^\"']+)[\"']"), cut(r"(?is)\"datePublished\"\s*:\s*\"([^\"]+)\"")]
    value = F.coalesce(*meta, *other, date_in_text(F.substring(F.regexp_replace(h, "<[^>]*>", " "), 1, 2000)))
    zoned = F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss")
    mail = F.date_format(F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")), "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(zoned, mail, F.when(published_at(value) != "", published_at(value)), F.lit(""))


def page_text(html: Column | str, most: int = 2500) -> Column:
    """Text of a page without scripts, styles and tags, cut at `most`."""
    h = F.col(html) if isinstance(html, str) else html
    t = F.regexp_replace(h, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, most)


def page_title(html: Column | str) -> Column:
    return F.trim(F.regexp_extract(F.col(html) if isinstance(html, str) else html, r"(?is)<title[^>]*>(.*?)</title>", 1))
