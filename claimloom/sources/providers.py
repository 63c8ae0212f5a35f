"""Rows as providers answer them, as evidence rows: text, title, source, url, score, type, search_provider."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip_words
from .readers import with_fallback

# A web search's fields for text (joined), title, source and url (the first that is filled), its name and score.
WEB = {
    "duckduckgo": (["body"], ["title"], ["title"], ["href", "url", "link"], "DuckDuckGo", 0.4),
    "serpapi": (["snippet"], ["title"], ["title"], ["link"], "SerpAPI", 0.55),
    "newsapi": (["description", "content"], ["title"], ["source.name"], ["url"], "NewsAPI", 0.5),
    "newsdata": (["description", "content"], ["title"], ["source_id"], ["link"], "NewsData", 0.5),
    "tavily": (["content"], ["title"], ["title"], ["url"], "Tavily", 0.5),
}
#: Search engines whose own score counts, and the characters that a query may have.
OWN_SCORE, QUERY_CHARS = ("tavily",), {"tavily": 400}
#: A structured source's score, and which of them go by another name.
STRUCTURED = {"nasa": 0.92, "openfda": 0.9, "wikipedia": 0.75, "arxiv": 0.86, "worldbank": 0.9, "wikidata": 0.8, "pib": 0.95}
ALIASES = {"gov_api": "pib", "isro": "nasa"}


def _field(rows: DataFrame, name: str) -> Column:
    """A field as text, empty where the rows have none."""
    top = name.split(".")[0]
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if top in rows.columns else F.lit("")


def _first(rows: DataFrame, names: list[str], default: str = "") -> Column:
    return F.coalesce(*[F.when(_field(rows, n) != "", _field(rows, n)) for n in names], F.lit(default))


def web_rows(rows: DataFrame, provider: str) -> DataFrame:
    """What a web search gave; columns of rows that have none of the new names stay."""
    text, title, source, url, name, score = WEB[provider]
    own = F.coalesce(F.col("score").cast("double"), F.lit(score)) if provider in OWN_SCORE and "score" in rows.columns else F.lit(score)
    made = {
        "text": F.trim(F.concat_ws(" ", *[_field(rows, n) for n in text])), "title": _first(rows, title, name), "source": _first(rows, source, name), "url": _first(rows, url),
        "score": own, "type": F.lit("web_search"), "search_provider": F.lit(provider),
    }
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def search_query(c: Column | str, provider: str) -> Column:
    """A query as the provider takes it: cut at a word where it is too long."""
    return clip_words(c, QUERY_CHARS[provider], 0.0) if provider in QUERY_CHARS else (F.col(c) if isinstance(c, str) else c)


def _nasa(r: DataFrame) -> tuple[Column, Column, Column]:
    return _first(r, ["description", "title"]), F.concat(F.lit("NASA: "), _first(r, ["title"], "result")), _first(r, ["href"])


def _openfda(r: DataFrame) -> tuple[Column, Column, Column]:
    return _first(r, ["purpose", "indications_and_usage"]), F.lit("OpenFDA"), F.lit("https://api.fda.gov/drug/label.json")


def _wikipedia(r: DataFrame) -> tuple[Column, Column, Column]:
    plain = F.regexp_replace(_field(r, "snippet"), "<[^>]*>", "")
    return plain, F.concat(F.lit("Wikipedia: "), _field(r, "title")), F.concat(F.lit("https://en.wikipedia.org/?curid="), _field(r, "pageid"))


def _arxiv(r: DataFrame) -> tuple[Column, Column, Column]:
    return _first(r, ["summary", "title"]), F.concat(F.lit("arXiv: "), F.substring(_field(r, "title"), 1, 120)), _first(r, ["link"])


def _worldbank(r: DataFrame) -> tuple[Column, Column, Column]:
    at = F.concat(F.lit("https://api.worldbank.org/v2/indicator/"), _field(r, "id"), F.lit("?format=json"))
    return F.concat(_field(r, "name"), F.lit(" ("), _field(r, "id"), F.lit(")")), F.concat(F.lit("World Bank: "), _first(r, ["source_name"], "World Bank")), at


def _wikidata(r: DataFrame) -> tuple[Column, Column, Column]:
    at = F.coalesce(F.when(_field(r, "concepturi") != "", _field(r, "concepturi")), F.concat(F.lit("https://www.wikidata.org/wiki/"), _field(r, "id")))
    return F.trim(F.concat(_field(r, "label"), F.lit(". "), _field(r, "description"))), F.concat(F.lit("Wikidata: "), _field(r, "label")), at


def _pib(r: DataFrame) -> tuple[Column, Column, Column]:
    return _first(r, ["title"]), F.lit("PIB"), _first(r, ["url", "link"])


_MADE: dict[str, Callable] = {"nasa": _nasa, "openfda": _openfda, "wikipedia": _wikipedia, "arxiv": _arxiv, "worldbank": _worldbank, "wikidata": _wikidata, "pib": _pib}


def structured_rows(rows: DataFrame, subtype: str, enabled: tuple[str, ...] = tuple(STRUCTURED)) -> DataFrame:
    """What a structured source gave; an unknown or disabled one counts as wikipedia."""
    name = ALIASES.get(subtype.lower(), subtype.lower())
    name = name if name in STRUCTURED and name in enabled else "wikipedia"
    text, source, url = _MADE[name](rows)
    made = {"text": text, "title": _field(rows, "title"), "source": source, "url": url, "score": F.lit(STRUCTURED[name]), "type": F.lit("structured_api"), "search_provider": F.lit(name)}
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def gathered(parts: list[DataFrame], by: list[str], pos: str, most: int = 3) -> DataFrame:
    """Rows of several answers to one query, each URL or text's beginning once, the `most` best scores of each group."""
    from ..operators.selection import first_per_key, top

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    key = F.when(F.trim(F.coalesce("url", F.lit(""))) != "", F.trim("url")).otherwise(F.lower(F.trim(F.substring(F.coalesce("text", F.lit("")), 1, 160))))
    return top(first_per_key(rows.where(key != ""), by, key, [pos]), by, [F.desc("score"), pos], most)


def matching(rows: DataFrame, by: list[str], tokens: Column, *fields: str) -> DataFrame:
    """Rows in whose fields one of the tokens occurs; all of a group where none does."""
    return with_fallback(rows, by, tokens, F.lower(F.concat_ws(" ", *fields)))
