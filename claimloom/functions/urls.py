"""URL functions and the source policy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Hosts and patterns of the policy.
TRUSTED = ["gov.in", "nic.in", "who.int", "worldbank.org", "wikipedia.org", "wikidata.org", "reuters.com", "bbc.com", "apnews.com", "nasa.gov"]
EXPLICIT = r"(?:^|[^a-z0-9])(?:xxx|porn|nsfw|hentai|sex-video|adult-video|erotic|nude)(?:[^a-z0-9]|$)"
FILE_EXTENSIONS = ["json", "xml", "csv", "zip", "jpg", "jpeg", "png", "gif", "mp4", "mp3"]


@dataclass(frozen=True)
class Policy:
    """What may be fetched and who is trusted."""

    bad_domains: tuple[str, ...] = ()
    blocked_tokens: tuple[str, ...] = ()
    trusted: tuple[str, ...] = tuple(TRUSTED)
    api_hosts: tuple[str, ...] = ()
    extensions: tuple[str, ...] = field(default=tuple(FILE_EXTENSIONS))
    block_wordpress: bool = True
    block_explicit: bool = True


def canonical_url(c: Column | str) -> Column:
    """Lower-cased without query, fragment and slashes at the end."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"[?#].*$", ""), r"/+$", ""))


def host(c: Column | str) -> Column:
    """The lower-cased host without port and outer dots; empty without a scheme."""
    h = F.regexp_extract(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), r"^[a-z][a-z0-9+.-]*://([^/:?#]+)", 1)
    return F.regexp_replace(h, r"^\.+|\.+$", "")


def loose_host(c: Column | str) -> Column:
    """The host of a URL with or without a scheme, without www."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(t, r"^([^/:?#]+)", 1), r"^www\.", "")


def in_domains(h: Column, domains) -> Column:
    """Whether a host is one of domains or below one: its suffixes are looked up, one comparison for each label."""
    if not domains:
        return F.lit(False)
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (h != "") & F.arrays_overlap(suffixes, F.array(*[F.lit(d) for d in domains]))


def explicit(url: Column, h: Column) -> Column:
    return F.concat_ws(" ", h, F.lower(F.coalesce(url, F.lit("")))).rlike(EXPLICIT)


def wordpress_like(url: Column, h: Column) -> Column:
    u = F.lower(F.coalesce(url, F.lit("")))
    return F.contains(h, F.lit("wordpress")) | F.contains(u, F.lit("/wp-content/")) | F.contains(u, F.lit("/wp-json/"))


def has_any(c: Column, tokens) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(c, F.lit(t))
    return out


def blocked(url: Column | str, p: Policy) -> Column:
    """Whether the search policy drops a row; rows without a URL stay."""
    u, h = col(url), host(url)
    out = in_domains(h, p.bad_domains) | has_any(F.lower(F.coalesce(u, F.lit(""))), p.blocked_tokens)
    if p.block_explicit:
        out = out | explicit(u, h)
    if p.block_wordpress:
        out = out | wordpress_like(u, h)
    return (F.coalesce(u, F.lit("")) != "") & out


def scrapable(url: Column | str, p: Policy) -> Column:
    """Whether a URL may be fetched as a page: http, a host, no API, no data file, and nothing that the policy blocks."""
    u = F.lower(F.trim(F.coalesce(col(url), F.lit(""))))
    path = F.regexp_extract(u, r"^https?://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    ok = u.rlike(r"^https?://[^/:?#]") & ~F.contains(path, F.lit("/api/")) & ~query.rlike("(?:format|output|alt)=json")
    if p.extensions:
        ok = ok & ~path.rlike(r"\.(?:" + "|".join(p.extensions) + ")$")
    if p.api_hosts:
        ok = ok & ~host(url).isin(*p.api_hosts)
    return ok & ~blocked(url, p)
