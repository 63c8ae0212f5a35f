"""Checkability, topics and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.patterns import FEW, group_hits
from ..functions.text import LEFT, RIGHT, SCRIPTS, once, words
from ..functions.urls import has_any
from ..functions.values import OPINION

# Sources that every route ends with, and the order of kinds of sources.
BASELINE_SOURCES = ["structured_api:wikipedia", "web_search:general", "scraping:general"]
PRIORITY = ["structured_api", "web_search", "scraping"]
#: Keywords of a taxonomy up to which it is held with the plan.
MOST_KEYWORDS = 50_000


def checkability(claim: Column | str, lang: Column | str, bypass: tuple[str, ...] = (), min_words: int = 6, opinion=OPINION, model: Column | None = None) -> Column:
    """struct(ok, reason): bypass language, too few words (without a model), question, opinion, the model's label, else checkable."""
    c = F.coalesce(claim, F.lit(""))
    short = (F.size(words(claim)) < min_words) if model is None and min_words > 0 else F.lit(False)
    out = F.when(F.lower(F.coalesce(lang, F.lit("en"))).isin(*bypass), "") if bypass else F.when(F.lit(False), "")
    out = out.when(short, "too_short").when(F.endswith(F.trim(c), F.lit("?")), "question").when(once(F.lower(c), lambda low: has_any(low, opinion)), "opinion")
    reason = out.otherwise("" if model is None else model)
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))


def factual_shape(c: Column | str) -> Column:
    t = F.col(c) if isinstance(c, str) else c
    return (F.trim(t) != "") & (t.rlike(r"\d") | t.rlike(LEFT + "[A-Z][a-z]+" + RIGHT) | (F.size(words(t)) >= 10))


def relax(lang: Column, label: Column, confidence: Column, claim: Column, labels: tuple[str, ...], block_at: float = 0.85) -> Column:
    """Whether an uncheckable label of another language is overruled: unsure, of a relaxed kind, and of factual shape."""
    return ~F.startswith(F.lower(lang), F.lit("en")) & F.upper(F.trim(label)).isin(*labels) & (confidence < block_at) & factual_shape(claim)


def _table(taxonomy: DataFrame, within: list[str]) -> list[tuple] | None:
    """(within, pos, label, keywords) of a taxonomy, in order; null for one of more than MOST_KEYWORDS keywords."""
    rows = taxonomy.select(*within, "pos", "label", "keyword").limit(MOST_KEYWORDS + 1).collect()
    if len(rows) > MOST_KEYWORDS:
        return None
    held: dict[tuple, list[str]] = {}
    for r in rows:
        keywords = held.setdefault((tuple(r[c] for c in within), r.pos, r.label), [])
        if r.keyword is not None:
            keywords.append(r.keyword)
    return [(*k, sorted(set(v))) for k, v in sorted(held.items(), key=str)]


def _best(hits: Column, table: list[tuple], start: int, within: list[Column]) -> Column:
    """struct(n, p, label) of the table's best label by the hits of its groups, which are numbered from `start`."""
    labels = F.array(*[F.struct(F.array(*[F.lit(x) for x in w]).cast("array<string>").alias("within"), F.lit(pos).alias("pos"), F.lit(label).alias("label")) for w, pos, label, _ in table])
    mine = F.filter(hits, lambda h: h["at"].between(start, start + len(table) - 1))
    of = lambda h: F.element_at(labels, h["at"] - start + 1)
    if within:
        mine = F.filter(mine, lambda h: of(h)["within"] == F.array(*[c.cast("string") for c in within]))
    return F.array_max(F.transform(mine, lambda h: F.struct(h["n"].alias("n"), (-of(h)["pos"]).alias("p"), of(h)["label"].alias("label"))))


def _judged(rows: DataFrame, divisor: int, cap: float, default: str, default_conf: float) -> DataFrame:
    """rows with label and conf of `_best`."""
    best = F.col("_best")
    got = F.coalesce(best["n"], F.lit(0)) > 0
    return rows.withColumn("label", F.when(got, best["label"]).otherwise(default)).withColumn("conf", F.when(got, F.least(best["n"] / F.lit(float(divisor)), F.lit(cap))).otherwise(default_conf)).drop("_best")


def topics(claims: DataFrame, taxonomy: DataFrame, key: str, text: str, divisor: int, cap: float, default: str, default_conf: float, within: list[str] | None = None) -> DataFrame:
    """claims with `label`, `conf`: the label (pos, label, keyword; and the columns of `within`) most of whose keywords the
    text contains, the first by pos of equals; conf is hits / divisor up to cap.

    A taxonomy of more than a few keywords is one automaton, which reads a text once for all of them. Smaller ones, and
    ones beyond MOST_KEYWORDS, are gathered into one array literal per label set. Rows are neither joined by inequality
    nor shuffled.
    """
    table = _table(taxonomy, within or [])
    if table is not None and sum(len(x[-1]) for x in table) > FEW:
        hits = group_hits(F.lower(F.coalesce(text, F.lit(""))), [x[-1] for x in table])
        rows = claims.withColumn("_hits", hits)
        return _judged(rows.withColumn("_best", _best(F.col("_hits"), table, 0, [F.col(c) for c in within or []])).drop("_hits"), divisor, cap, default, default_conf)
    dim = taxonomy.groupBy(*(within or []), "pos", "label").agg(F.collect_set("keyword").alias("ks"))
    dim = dim.groupBy(*(within or [])).agg(F.sort_array(F.collect_list(F.struct("pos", "label", "ks"))).alias("_dim"))
    joined = claims.join(dim, within, "left") if within else claims.crossJoin(F.broadcast(dim))
    low = F.lower(F.coalesce(text, F.lit("")))
    # the text is lower-cased once a row: as the element of an array it has a name
    of = lambda x: F.transform("_dim", lambda d: F.struct(F.size(F.filter(d["ks"], lambda k: F.contains(x, k))).alias("n"), (-d["pos"]).alias("p"), d["label"].alias("label")))
    best = F.transform(F.array(low), lambda x: F.array_max(of(x)))[0]
    return _judged(joined.withColumn("_best", best).drop("_dim"), divisor, cap, default, default_conf)


def classify(claims: DataFrame, level1: DataFrame, level2: DataFrame, key: str, text: str) -> DataFrame:
    """claims with level1, conf1, level2, conf2: the topic and, within it, the subtopic; general at 0.3 where the topic is
    unsure. Two tables of many keywords share one pass over the text."""
    first, second = (3, 0.85, "GENERAL_FACTUAL", 0.5), (2, 0.9, "general", 0.3)
    tables = _table(level1, []), _table(level2, ["level1"])
    if None not in tables and sum(len(x[-1]) for t in tables for x in t) > FEW:
        low = F.lower(F.coalesce(text, F.lit("")))
        rows = claims.withColumn("_hits", group_hits(low, [x[-1] for t in tables for x in t]))
        one = _judged(rows.withColumn("_best", _best(F.col("_hits"), tables[0], 0, [])), *first).withColumnRenamed("label", "level1").withColumnRenamed("conf", "conf1")
        two = _judged(one.withColumn("_best", _best(F.col("_hits"), tables[1], len(tables[0]), [F.col("level1")])).drop("_hits"), *second)
    else:
        one = topics(claims, level1, key, text, *first).withColumnRenamed("label", "level1").withColumnRenamed("conf", "conf1")
        two = topics(one, level2, key, text, *second, ["level1"])
    weak = F.col("conf1") < 0.4
    return two.withColumn("level2", F.when(weak, "general").otherwise(F.col("label"))).withColumn("conf2", F.when(weak, 0.3).otherwise(F.col("conf"))).drop("label", "conf")


# Terms that override an unsure topic, in order.
OVERRIDES = [
    (["act", "section", "fir", "court", "legal", "law", "police"], "LAW_CRIME", "regulation"),
    (["gst", "tax", "parliament", "assembly", "government", "policy", "constitution"], "POLITICS_GOVERNMENT", "public_policy"),
    (["gdp", "inflation", "budget", "fiscal", "repo rate", "stock", "market", "rupee", "export", "import"], "ECONOMICS_BUSINESS", "macroeconomics"),
    (["accident", "crash", "killed", "injured", "blast", "fire", "murder", "attack", "arrest"], "LAW_CRIME", "criminal_cases"),
    (["imdb", "box office", "movie", "film", "cinema", "song", "album"], "ENTERTAINMENT", "film"),
]


def overridden(rows: DataFrame, text: str, rules=OVERRIDES) -> DataFrame:
    """Rows with level1, level2 replaced by the first rule that their text meets, where the topic is unsure."""
    low = F.lower(F.coalesce(text, F.lit("")))
    weak = (F.col("conf1") < 0.65) | F.col("level1").isin("GENERAL_FACTUAL", "TECHNOLOGY")
    new1, new2 = F.col("level1"), F.col("level2")
    for terms, a, b in reversed(rules):
        hit = weak & has_any(low, terms)
        new1, new2 = F.when(hit, a).otherwise(new1), F.when(hit, b).otherwise(new2)
    return rows.withColumn("_b", new2).withColumn("level1", new1).withColumn("level2", F.col("_b")).drop("_b")


def route(rows: DataFrame, table: DataFrame, level1: str = "level1", level2: str = "level2", general: str = "GENERAL_FACTUAL", baseline: list[str] | None = None) -> DataFrame:
    """rows with `sources`, distinct: those of (level1, level2), else of (level1, _default), else of the general topic; the
    baseline ones follow. Kinds come in the order of PRIORITY, others last, each in that order. table: level1, level2, pos,
    source, a small dimension."""
    dim = table.groupBy("level1", "level2").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("s"))
    at = lambda a, b, name: dim.select(F.col("level1").alias(a), F.col("level2").alias(b), F.col("s").alias(name))
    r = rows.join(at("_a", "_b", "_s1"), (F.col(level1) == F.col("_a")) & (F.col(level2) == F.col("_b")), "left").drop("_a", "_b")
    d = at("_a", "_b", "_s2").where("_b = '_default'").drop("_b")
    r = r.join(d, F.col(level1) == F.col("_a"), "left").drop("_a")
    g = d.where(F.col("_a") == general).select(F.col("_s2").alias("_s3"))
    r = r.crossJoin(F.broadcast(g.union(rows.sparkSession.sql("SELECT cast(array() AS array<string>)")).limit(1)))
    own = F.coalesce("_s1", "_s2", "_s3")
    base = F.array(*[F.lit(x) for x in (BASELINE_SOURCES if baseline is None else baseline)])
    return r.withColumn("sources", by_priority(F.array_union(own, base))).drop("_s1", "_s2", "_s3")


def by_priority(sources: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in PRIORITY])
    place = lambda x: F.when(F.array_position(kinds, F.split(x, ":")[0]) > 0, F.array_position(kinds, F.split(x, ":")[0])).otherwise(len(PRIORITY) + 1)
    return F.transform(F.array_sort(F.transform(sources, lambda x, i: F.struct(place(x).alias("k"), i.alias("i"), x.alias("x")))), lambda y: y["x"])


def image_claim(c: Column | str) -> Column:
    """The text after a leading question that ends before position 140, if over 40 characters follow its start; space and
    runs of end marks collapsed."""
    t = F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    at = F.instr(t, "?")
    rest = F.trim(F.substring(t, at + 1, F.length(t)))
    out = F.when((at > 0) & (at <= 140) & (F.length(t) - at + 1 > 40) & (rest != ""), rest).otherwise(t)
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), r"([.!?])\1+", "$1")


def several_claims(c: Column | str) -> Column:
    """Whether at least two pieces between ends of sentences, lines or bullets have 20 characters and five words."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    parts = F.transform(F.split(t, r"[\n\r]+|[.!?।]+|•|-{2,}"), lambda x: F.trim(x))
    return F.size(F.filter(parts, lambda x: (F.length(x) >= 20) & (F.size(F.split(x, r"\s+")) >= 5))) >= 2


def verifier_input(rows: DataFrame, by: list[str], verdict: str, confidence: str, pos: str, gray=(0.35, 0.65), most: int = 6, relevance: float = 0.86, credibility: float = 0.65) -> DataFrame:
    """The rows that a verifier would be shown: a neutral verdict's good neutral rows, an unsure verdict's most relevant ones."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("relevance"), pos))
    neutral = (F.col(verdict) == "neutral") & (F.col("stance") == "neutral") & (F.col("relevance") >= relevance) & (F.col("credibility") >= credibility)
    unsure = F.col(verdict).isin("support", "refute") & F.col(confidence).between(*gray)
    return rows.withColumn("_n", n).where(neutral | (unsure & (F.col("_n") <= most))).drop("_n")


def script_language(c: Column | str) -> Column:
    t = F.col(c) if isinstance(c, str) else c
    return F.coalesce(*[F.when(t.rlike(p), k) for k, p in SCRIPTS.items()], F.lit("en"))


def route_many(rows: DataFrame, routes: list[str], by: list[str]) -> DataFrame:
    """rows with `sources` as the ordered union of up to three arrays of sources."""
    out = F.col(routes[0])
    for r in routes[1:3]:
        out = F.array_union(out, F.coalesce(r, F.array().cast("array<string>")))
    return rows.withColumn("sources", out)


def first_seen(rows: DataFrame, by: list[str], value: Column, pos: str, name: str) -> DataFrame:
    """by, name: the distinct values of each group in the order in which they are first seen; null and empty ones aside."""
    r = rows.withColumn("_v", value).where(F.coalesce("_v", F.lit("")) != "").groupBy(*by, "_v").agg(F.min(pos).alias("_p"))
    return r.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_v"))), lambda x: x["_v"]).alias(name))


def fold_source(kind: Column, subtype: Column) -> Column:
    """type:subtype with the subtypes of web search folded to news and generic."""
    s = F.lower(F.trim(F.coalesce(subtype, F.lit(""))))
    return F.concat_ws(":", kind, F.when(kind == "web_search", F.when(F.contains(s, F.lit("news")), "news").otherwise("generic")).otherwise(s))


def with_rank(rows: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
