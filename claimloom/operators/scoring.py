"""Scores of evidence rows: relevance, stance, credibility, weight, tiers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import FEW, first_hit, hit_counts
from ..functions.text import STOPWORDS, clamp, entity, fact_span, first_date, numeric_claim, once, overlap_ratio, token_set, word_count, word_set
from ..functions.urls import has_any, host, in_domains
from ..functions.values import CREDIBILITY, DISCUSSION, HALF_LIFE, HIGH_TRUST, LOW_TRUST, NEUTRAL_CUES, POLARITY_REFUTE, POLARITY_SUPPORT, REFUTE_CUES, SUPPORT_CUES

#: Entries of a credibility table up to which it is an ordered CASE.
LONG_TABLE = 200


def zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def keyword_relevance(claim: Column | str, text: Column | str) -> Column:
    """1.5 times the share of the claim's words that the text has, stop words aside, at most 1; 0.3 for a claim without words."""
    c, t = word_set(claim, STOPWORDS), word_set(text, STOPWORDS)
    return F.when(F.size(c) == 0, 0.3).otherwise(F.least(F.size(F.array_intersect(c, t)) / F.size(c) * 1.5, F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def embedding_relevance(a: Column, b: Column) -> Column:
    return (cosine(a, b) + 1) / 2


def cue_hits(text: Column, cues) -> Column:
    """How many of the cues the text contains; many of them are looked for in one pass."""
    if len(cues) > FEW:
        return hit_counts(text, [cues])[0]
    return reduce(add, [F.contains(text, F.lit(c)).cast("int") for c in cues])


def keyword_stance(claim: Column | str, text: Column | str, support=SUPPORT_CUES, refute=REFUTE_CUES, neutral=NEUTRAL_CUES) -> Column:
    """struct(support, refute, neutral): cue hits, 0.3 for each shared word over three, over their total and 0.1. Stop words count here."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    shared = F.size(F.array_intersect(word_set(claim), word_set(text)))

    def shares(x: Column) -> Column:
        s = x["s"].cast("double") + F.when(x["shared"] > 3, x["shared"] * 0.3).otherwise(0.0)
        r, n = x["r"].cast("double"), x["n"].cast("double")
        total = s + r + n + 0.1
        return F.struct((s / total).alias("support"), (r / total).alias("refute"), (n / total).alias("neutral"))

    if max(len(support), len(refute), len(neutral)) > FEW:  # one pass for all of them
        held = F.array(F.struct(hit_counts(low, [support, refute, neutral]).alias("n"), shared.alias("shared")))
        found = F.transform(held, lambda x: F.struct(x["n"][0].alias("s"), x["n"][1].alias("r"), x["n"][2].alias("n"), x["shared"].alias("shared")))
        return F.transform(found, shares)[0]
    # the lower-cased text, words and cues are found once a row: as elements of arrays they have names
    found = F.transform(F.array(low), lambda x: F.struct(cue_hits(x, support).alias("s"), cue_hits(x, refute).alias("r"), cue_hits(x, neutral).alias("n"), shared.alias("shared")))
    return F.transform(found, shares)[0]


def branch_stance(lang: Column, branch: Column, first: Column, second: Column | None, mixed: bool = True) -> Column:
    """The stance of one of two models: the English one's, `second`, for rows of the English branch of another language's claim
    where branches are mixed and that model gave an answer, else `first`."""
    if second is None or not mixed:
        return first
    other = (F.lower(F.coalesce(lang, F.lit("en"))) != "en") & (F.coalesce(branch, F.lit("")) == "en") & second.isNotNull()
    return F.when(other, second).otherwise(first)


def stance_label(p: Column) -> Column:
    """The largest of support, refute, neutral; the first of equals."""
    return F.when((p["support"] >= p["refute"]) & (p["support"] >= p["neutral"]), "support").when(p["refute"] >= p["neutral"], "refute").otherwise("neutral")


def polarity(claim: str, title: str, text: str, probs: str, relevance: str = "relevance", shift: float = 0.12, floor: float = 0.2, least_relevance: float = 0.9, support=POLARITY_SUPPORT, refute=POLARITY_REFUTE) -> Column:
    """probs moved from neutral towards the one direction that cues show, for relevant rows where neutral leads."""
    blob = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    pos, neg = cue_hits(blob, support), cue_hits(blob, refute)
    s, r, n = (F.coalesce(F.col(f"{probs}.{k}"), F.lit(0.0)) for k in ("support", "refute", "neutral"))
    on_topic = (F.size(token_set(claim)) == 0) | F.arrays_overlap(token_set(claim), token_set(blob))
    act = ~((pos > 0) & (neg > 0)) & (n >= F.greatest(s, r)) & (zero(relevance) >= least_relevance) & on_topic
    take = F.least(F.lit(max(0.0, min(0.25, shift))), F.greatest(F.lit(0.0), n - floor))
    up, down = F.when(act & (pos > neg), take).otherwise(0.0), F.when(act & (neg > pos), take).otherwise(0.0)
    total = F.when(act & (s + r + n > 0), s + r + n).otherwise(1.0)
    return F.struct(((s + up) / total).alias("support"), ((r + down) / total).alias("refute"), ((n - up - down) / total).alias("neutral"))


def table_credibility(source: Column, url: Column, table=CREDIBILITY) -> Column:
    """The value of the table's first entry that the source or the URL contains, null without one. A table of over
    LONG_TABLE entries is looked for in one pass over both; source and URL are short, so that up to there an ordered CASE
    in generated code is the cheaper plan."""
    if len(table) > LONG_TABLE:
        names, values = [n for n, _ in table], F.array(*[F.lit(float(v)) for _, v in table])
        return F.get(values, F.least(first_hit(source, names), first_hit(url, names)))
    out = F.lit(None).cast("double")
    for name, value in reversed(table):
        out = F.when(F.contains(source, F.lit(name)) | F.contains(url, F.lit(name)), value).otherwise(out)
    return out


def scraped_credibility(date: Column, overlap: Column, structured: Column, corroboration: Column, boilerplate: Column, penalty: float = 0.2) -> Column:
    dyn = F.lit(0.5) + F.when(F.trim(F.coalesce(date, F.lit(""))) != "", 0.07).otherwise(0.0)
    dyn = dyn + clamp(F.coalesce(overlap, F.lit(0.0)) * 0.22, 0, 0.18) + F.when(F.coalesce(structured, F.lit(False)), 0.08).otherwise(0.0)
    dyn = dyn + clamp(F.coalesce(corroboration, F.lit(0.0)), 0, 0.15) - clamp(F.coalesce(boilerplate, F.lit(0.0)) * penalty, 0, 0.3)
    return clamp(dyn, 0.35, 0.92)


def credibility(source: str = "source", url: str = "url", kind: str = "type", dynamic: Column | None = None, table=CREDIBILITY) -> Column:
    """0.9 for structured sources; else the table's; else 0.7 for searches and 0.5. `dynamic` raises scraped rows."""
    s, u = F.lower(F.coalesce(source, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    known = table_credibility(s, u, table)
    out = F.coalesce(known, F.when(F.col(kind) == "web_search", 0.7).otherwise(0.5))
    if dynamic is not None:
        out = F.when(F.col(kind) == "scraping", F.greatest(known, dynamic)).otherwise(out)
    return F.when(F.col(kind) == "structured_api", 0.9).otherwise(out)


def simple_credibility(source: Column, table=CREDIBILITY, default: float = 0.7) -> Column:
    return F.coalesce(table_credibility(F.lower(source), F.lit(""), table), F.lit(default))


def tier_multiplier(source: str = "source", url: str = "url", high=HIGH_TRUST, low=LOW_TRUST) -> Column:
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    h = host(url)
    text = F.concat_ws(" ", F.lower(F.coalesce(source, F.lit(""))), h, u)
    return F.when(in_domains(h, high) | has_any(text, high), 1.05).when(has_any(text, low), 0.80).when(u.rlike(DISCUSSION), 0.85).otherwise(1.0)


def temporal_weight(date: Column, relevance: Column, context: Column, as_of: str, half_life: dict[str, int] = HALF_LIFE) -> Column:
    """0.5 to the age in half-lives, softened for relevant rows, at least 0.4; 1 without a date or decay, 0.8 for an unreadable date."""
    life = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in half_life.items() for x in kv]), context), F.lit(999))
    age = F.datediff(F.lit(as_of).cast("date"), F.substring(date, 1, 10).try_cast("date")) / 30.44
    w = F.pow(F.lit(0.5), age / life)
    w = F.when(relevance >= 0.95, F.least(F.lit(1.0), w + 0.35)).when(relevance >= 0.9, F.least(F.lit(1.0), w + 0.25)).when(relevance >= 0.8, F.least(F.lit(1.0), w + 0.1)).otherwise(w)
    return F.when((F.coalesce(date, F.lit("")) == "") | (life > 500), 1.0).when(age.isNull(), 0.8).otherwise(F.greatest(w, F.lit(0.4)))


def lifted(cred: Column, relevance: Column) -> Column:
    """Credibility below 0.82 is raised by 0.15, up to 0.82, for relevance of 0.95."""
    return F.when((relevance >= 0.95) & (cred < 0.82), F.least(F.lit(0.82), cred + 0.15)).otherwise(cred)


def weight(relevance: Column, cred: Column, temporal: Column, tier: Column) -> Column:
    return relevance * lifted(cred, relevance) * temporal * tier


def _blend(parts: list[tuple[float, Column]]) -> Column:
    total = max(1e-9, sum(w for w, _ in parts))
    return reduce(add, [F.lit(w / total) * clamp(F.coalesce(c, F.lit(0.0))) for w, c in parts])


def hybrid_rank(relevance: Column, cred: Column, stance_conf: Column, alpha: float = 0.55, beta: float = 0.25, gamma: float = 0.2) -> Column:
    return _blend([(alpha, relevance), (beta, cred), (gamma, stance_conf)])


def research_weight(relevance: Column, stance_conf: Column, trust: Column, alpha: float = 0.5, beta: float = 0.3, gamma: float = 0.2) -> Column:
    return clamp(_blend([(alpha, relevance), (beta, stance_conf), (gamma, trust)]))


def weighted_stance(p: Column, w: Column) -> Column:
    """Probabilities times the weight, once and for all: nothing later multiplies by the weight again."""
    return F.struct(*[(p[k] * w).alias(k) for k in ("support", "refute", "neutral")])


def selector_score(quality: Column) -> Column:
    """A quality score over 100; null and 0 count as 50."""
    return clamp(F.when(F.coalesce(quality, F.lit(0.0)) == 0, 50.0).otherwise(quality) / 100.0)


def effective_relevance(relevance: Column, selector: Column) -> Column:
    return F.least(F.lit(1.0), relevance * 0.85 + selector * 0.15)


def evidence_tier(effective: Column, cred: Column, strong=(0.45, 0.40), soft=(0.30, 0.25)) -> Column:
    return F.when((effective >= strong[0]) & (cred >= strong[1]), "strong").when((effective >= soft[0]) & (cred >= soft[1]), "soft").otherwise("reject")


def lane(kind: Column, branch: Column) -> Column:
    return F.when(F.lower(kind) == "structured_api", "structured_reference").when(F.lower(branch) == "en", "translated_en").otherwise("native_local")


def lane_weight(lane_name: Column, structured: float = 1.10, native: float = 1.00, translated: float = 0.92) -> Column:
    return F.when(lane_name == "structured_reference", structured).when(lane_name == "translated_en", translated).otherwise(native)


def structured_boost(kind: Column, structured: Column, quality: Column, relevance: Column, least: float = 0.62, boost: float = 0.08) -> Column:
    """Relevance, raised for structured scraped rows of good quality."""
    return F.when((F.lower(kind) == "scraping") & structured & (quality >= least), clamp(relevance + boost)).otherwise(relevance)


def scrape_quality(score: Column, text: Column, title: Column, overlap: Column, boilerplate: Column, penalty: float = 0.2) -> Column:
    return score + F.least(F.length(text), F.lit(4000)) / 4000.0 + F.when(F.coalesce(title, F.lit("")) != "", 0.05).otherwise(0.0) + overlap * 0.8 - boilerplate * penalty


def structured_quality(overlap: Column, date: Column, numeric: Column, entity: Column) -> Column:
    """0.55 of the share of the claim's words, 0.20 for a date, 0.15 for a number, 0.10 for a name."""
    part = lambda c, w: F.when(F.coalesce(c, F.lit("")) != "", w).otherwise(0.0)
    return clamp(F.coalesce(overlap, F.lit(0.0)) * 0.55 + part(date, 0.20) + part(numeric, 0.15) + part(entity, 0.10))


def enriched(rows: DataFrame, claim: str = "claim", text: str = "text", least: float = 0.62, span_chars: int = 60) -> DataFrame:
    """Scraped rows with fact_span, entity, date, numeric_claim, scrape_struct_quality and structured_from_scrape, found in the
    span of facts or else in the text; a span of 60 characters takes the text's place. Rows without text stay as they are,
    with nulls."""
    t, c = F.trim(F.coalesce(text, F.lit(""))), token_set(claim)
    r = rows.withColumn("fact_span", F.when(t != "", fact_span(t, c)))
    of = F.when(F.col("fact_span") != "", F.col("fact_span")).otherwise(t)
    r = r.withColumns({"entity": F.when(t != "", entity(of)), "date": F.when(t != "", first_date(of)), "numeric_claim": F.when(t != "", numeric_claim(of)), "_overlap": overlap_ratio(token_set(of), c)})
    r = r.withColumn("scrape_struct_quality", F.when(t != "", structured_quality(F.col("_overlap"), F.col("date"), F.col("numeric_claim"), F.col("entity"))))
    r = r.withColumn("structured_from_scrape", F.col("scrape_struct_quality") >= least).drop("_overlap")
    return r.withColumn(text, F.when(F.length("fact_span") >= span_chars, F.col("fact_span")).otherwise(F.col(text)))


# Hosts by prior, words of hosts that raise a candidate, and the words that mark claims and headings.
PRIOR_HOSTS = [
    (["gov", "nic.in", "who.int", "worldbank.org", "un.org", "nasa.gov", "wikipedia.org"], 0.95),
    (["reuters.com", "bbc.com", "apnews.com"], 0.90),
    (["arxiv.org", "nature.com", "science.org"], 0.88),
    (["medium.com", "blog", "wordpress"], 0.55),
]
RAISED_HOSTS = ["gov", "who.int", "worldbank", "wikipedia", "reuters", "bbc"]
REPORT_WORDS = ["according to", "reported", "states"]
IMPACT_WORDS = ["killed", "affected", "flooding", "struck", "surge", "deaths", "injured", "displaced"]
HEADING_WORDS = ["introduction", "figure:", "table:", "contents", "environmental impact assessment"]


def domain_prior(h: Column) -> Column:
    out = F.when(h == "", 0.5)
    for hosts, prior in PRIOR_HOSTS:
        out = out.when(has_any(h, hosts), prior)
    return out.otherwise(0.70)


def prescore(query_tokens: Column, text_tokens: Column) -> Column:
    n = F.size(query_tokens)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(query_tokens, text_tokens)) / n * 1.4))


def candidate_score(lexical: Column, h: Column, score: Column) -> Column:
    bonus = F.when(has_any(h, RAISED_HOSTS), 0.06).otherwise(0.0)
    return clamp(lexical * 0.45 + domain_prior(h) * 0.35 + F.coalesce(score, F.lit(0.5)) * 0.2 + bonus)


def domain_weight(score: Column, domain: Column) -> Column:
    d = F.lower(F.coalesce(domain, F.lit("")))
    return clamp(score * F.when(F.contains(d, F.lit("science")), 1.1).when(F.contains(d, F.lit("social")), 0.8).otherwise(1.0))


def quality_score(kind: Column, relevance: Column, text: Column, url: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return (
        F.when(kind == "structured_api", 40.0).when(kind == "web_search", 25.0).otherwise(15.0)
        + relevance * 30
        + F.when(n > 100, 20.0).when(n > 50, 15.0).when(n > 20, 10.0).otherwise(0.0)
        + F.when(F.coalesce(url, F.lit("")) != "", 10.0).otherwise(0.0)
    )


def weighted_score(scores: Column, weights: Column) -> Column:
    """The mean of a map of scores by a map of weights, in 0..1; missing scores are 0, a total weight of 0 counts as 1."""
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, x: a + x)
    s = F.aggregate(F.map_entries(weights), F.lit(0.0), lambda a, e: a + F.coalesce(F.element_at(scores, e["key"]), F.lit(0.0)) * e["value"])
    return clamp(s / F.when(total == 0, 1.0).otherwise(total))


def verified_stance(verdict: Column) -> Column:
    """The probabilities that a verifier's verdict stands for."""
    one = lambda k: F.when(verdict == k, 0.98).otherwise(0.01).alias(k)
    return F.struct(one("support"), one("refute"), one("neutral"))


def claim_score(c: Column | str, n: Column | None = None) -> Column:
    """How much a sentence, of n words if that is known, looks like a checkable claim: numbers, years, names, reports, impact, a
    length of about 28 words."""
    t = F.col(c) if isinstance(c, str) else c
    hit = lambda cond, v: F.when(cond, v).otherwise(0.0)
    digit = t.rlike("[0-9]")  # the patterns of numbers have one
    score = lambda low: (
        hit(digit & t.rlike(r"(?:^|[^\p{L}\p{N}_])(?:19|20)\d{2}(?:$|[^\p{L}\p{N}_])"), 2.0)
        + hit(F.contains(t, F.lit("%")) | (digit & t.rlike(r"(?:^|[^\p{L}\p{N}_])\d+(?:$|[^\p{L}\p{N}_])")), 1.5)
        + hit(has_any(low, REPORT_WORDS), 1.0)
        + hit(t.rlike(r"[A-Z](?<![\p{L}\p{N}_][A-Z])[a-z]+(?![\p{L}\p{N}_])"), 1.0)
        + hit(has_any(low, IMPACT_WORDS), 1.8)
        + hit(digit & t.rlike(r"(?:^|[^\p{L}\p{N}_])(?:on|in)\s+\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}(?:$|[^\p{L}\p{N}_])"), 1.2)
        - hit(has_any(low, HEADING_WORDS), 2.0)
        - hit(F.trim(t).rlike(r"^[A-Z][A-Za-z\s:,-]{0,120}$"), 1.2)
        + F.greatest(F.lit(0.0), F.lit(1.0) - F.abs((word_count(t) if n is None else n) - 28) / 40.0)
    )
    return once(F.lower(t), score)
