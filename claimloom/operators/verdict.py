"""Verdicts from scored evidence: sums, decisive override, quality gate, calibration, reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp
from ..functions.urls import host


@dataclass(frozen=True)
class Options:
    conflict_support: float = 0.40
    conflict_refute: float = 0.40
    decisive_min_total: float = 0.35
    decisive_min_gap: float = 0.15
    soft_factor: float = 0.60
    gate_rows: int = 4
    gate_non_neutral: int = 2
    gate_hosts: int = 2
    gate_types: int = 1
    gate_strong: int = 1
    gate_relevance: float = 0.50
    gate_credibility: float = 0.40
    gate_failed: int = 2
    conf_en: float = 0.55
    gap_en: float = 0.08
    conf_multi: float = 0.60
    gap_multi: float = 0.12
    neutral_count: int = 2
    neutral_relevance: float = 0.86
    neutral_credibility: float = 0.65


def total(c: Column) -> Column:
    """A sum of doubles that does not depend on the order of the rows: exact to 12 places in decimals."""
    return F.sum(c.cast("decimal(30,12)")).cast("double")


def sum_columns(weighted: str = "weighted", weight: str = "evidence_weight") -> list[Column]:
    w = total(F.col(weight))
    part = lambda k: (total(F.col(f"{weighted}.{k}")) / F.when(w > 0, w).otherwise(1.0)).alias(f"agg_{k}")
    return [part("support"), part("refute"), part("neutral"), F.count("*").alias("evidence_count")]


def sums(evidence: DataFrame, by: str, weighted: str = "weighted", weight: str = "evidence_weight") -> DataFrame:
    """by, agg_support, agg_refute, agg_neutral (weighted stance over total weight), evidence_count."""
    return evidence.groupBy(by).agg(*sum_columns(weighted, weight))


def verdict(agg: DataFrame, o: Options = Options()) -> DataFrame:
    """agg with conflict, verdict and confidence. A side leads only if strictly ahead of both others; strong evidence on both
    sides is a conflict and neutral; few rows lower the confidence."""
    s, r, n, k = F.col("agg_support"), F.col("agg_refute"), F.col("agg_neutral"), F.col("evidence_count")
    times = F.when(k < 2, 0.75).when(k <= 3, 0.85).otherwise(1.0)
    conflict = (s > o.conflict_support) & (r > o.conflict_refute)
    out = agg.withColumn("conflict", conflict)
    out = out.withColumn("verdict", F.when(conflict, "neutral").when((s > r) & (s > n), "support").when((r > s) & (r > n), "refute").otherwise("neutral"))
    conf = F.when(conflict, clamp(n, 0.5, 0.7)).when(F.col("verdict") == "support", s).when(F.col("verdict") == "refute", r).otherwise(n)
    return out.withColumn("confidence", F.when(conflict, conf * times).otherwise(clamp(conf * times)))


def with_missing(claims: DataFrame, verdicts: DataFrame, by: str, checkable: Column | None = None) -> DataFrame:
    """A row for every claim: neutral 0.3 without evidence, neutral 0 where it is not checkable."""
    out = claims.join(verdicts, by, "left")
    ok = F.lit(True) if checkable is None else checkable
    out = out.withColumn("verdict", F.when(ok, F.coalesce("verdict", F.lit("neutral"))).otherwise("neutral"))
    return out.withColumn("confidence", F.when(ok, F.coalesce("confidence", F.lit(0.3))).otherwise(0.0)).withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0).cast("long")))


def decisive_columns(o: Options = Options(), tier: str = "evidence_tier", stance: str = "stance", weight: str = "evidence_weight") -> list[Column]:
    t = F.lower(F.when(F.coalesce(tier, F.lit("")) == "", "soft").otherwise(F.col(tier)))
    f = F.when(t == "strong", 1.0).when(t == "soft", o.soft_factor).otherwise(0.0)
    side = lambda k: F.coalesce(total(F.when(F.col(stance) == k, F.col(weight) * f)), F.lit(0.0)).alias(f"{k}_score")
    return [side("support"), side("refute"), F.count_if((t == "strong") & F.col(stance).isin("support", "refute")).alias("strong_count")]


def decisive(evidence: DataFrame, by: str, o: Options = Options()) -> DataFrame:
    """by, support_score, refute_score, strong_count: weights of support and refute, soft ones at soft_factor; a row without a
    tier is soft."""
    return evidence.groupBy(by).agg(*decisive_columns(o))


def apply_decisive(v: DataFrame, d: DataFrame, by: str, o: Options = Options()) -> DataFrame:
    return decide(v.join(d, by), F.lit(True), o)


# The sentences that later stages add to the reasons.
NOT_DECISIVE = "Phase7 decisive guard: insufficient decisive support/refute evidence."
DECISIVE = "Phase7 decisive aggregation selected non-neutral verdict from strong/soft evidence."
GATED = "Multi retrieval quality gate abstained: evidence quality/diversity too weak for non-neutral verdict."
CALIBRATED = "Calibration abstain: support/refute margin or confidence below threshold."


def noted(v: DataFrame, sentence: Column) -> DataFrame:
    """v whose reasons, if it has any, are followed by a sentence; a null one adds nothing."""
    return v.withColumn("reasoning", F.trim(F.concat_ws(" ", "reasoning", sentence))) if "reasoning" in v.columns else v


def decide(v: DataFrame, where: Column, o: Options = Options()) -> DataFrame:
    """Verdicts of other languages: neutral without strong evidence, enough in total and a gap; else the heavier side."""
    s, r = F.col("support_score"), F.col("refute_score")
    gap = F.abs(s - r)
    weak = (F.col("strong_count") == 0) | (s + r < o.decisive_min_total) | (gap < o.decisive_min_gap)
    conf = F.when(weak, F.greatest("confidence", F.lit(0.45))).otherwise(F.greatest(F.col("confidence"), clamp(gap / F.greatest(s + r, F.lit(1e-6)), 0.5, 0.99)))
    out = noted(v, F.when(where & weak, NOT_DECISIVE).when(where, DECISIVE))
    out = out.withColumn("confidence", F.when(where, conf).otherwise(F.col("confidence")))
    return out.withColumn("verdict", F.when(~where, F.col("verdict")).when(weak, "neutral").when(s > r, "support").otherwise("refute")).drop("support_score", "refute_score", "strong_count")


def gate_column(o: Options = Options(), kind: str = "type", url: str = "url", stance: str = "stance", tier: str = "evidence_tier") -> Column:
    nn = F.col(stance).isin("support", "refute")
    h, t = host(url), F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    mean = lambda c: F.coalesce(total(F.when(nn, F.coalesce(c, F.lit(0.0)))) / F.count_if(nn), F.lit(0.0))
    checks = [
        F.count("*") < o.gate_rows,
        F.count_if(nn) < o.gate_non_neutral,
        F.count_distinct(F.when(h != "", h)) < o.gate_hosts,
        F.count_distinct(F.when(t != "", t)) < o.gate_types,
        F.count_if(nn & (F.col(tier) == "strong")) < o.gate_strong,
        F.when(F.count_if(nn) == 0, True).otherwise(mean(F.col("relevance")) < o.gate_relevance),
        F.when(F.count_if(nn) == 0, True).otherwise(mean(F.col("credibility")) < o.gate_credibility),
    ]
    failed = checks[0].cast("int")
    for c in checks[1:]:
        failed = failed + c.cast("int")
    return failed.cast("long").alias("failed")


def gate(evidence: DataFrame, by: str, o: Options = Options()) -> DataFrame:
    """by, failed: how many of seven checks of quantity, variety and quality a claim's evidence fails."""
    return evidence.groupBy(by).agg(gate_column(o))


def apply_gate(v: DataFrame, g: DataFrame, by: str, o: Options = Options()) -> DataFrame:
    return abstain(v.join(g, by), F.lit(True), o)


def abstain(out: DataFrame, where: Column, o: Options = Options()) -> DataFrame:
    """Support and refute become neutral where the evidence failed too many checks."""
    stop = where & F.col("verdict").isin("support", "refute") & (F.col("failed") >= o.gate_failed)
    return noted(out, F.when(stop, GATED)).withColumn("confidence", F.when(stop, clamp(F.col("confidence"), 0.45, 0.65)).otherwise(F.col("confidence"))).withColumn("verdict", F.when(stop, "neutral").otherwise(F.col("verdict"))).drop("failed")


def calibrate(v: DataFrame, english: Column, o: Options = Options()) -> DataFrame:
    """Support and refute stand only with enough confidence and distance from the other side, less for English."""
    conf, gap = F.when(english, o.conf_en).otherwise(o.conf_multi), F.when(english, o.gap_en).otherwise(o.gap_multi)
    ok = ~F.col("verdict").isin("support", "refute") | ((F.col("confidence") >= conf) & (F.abs(F.col("agg_support") - F.col("agg_refute")) >= gap))
    lower = F.greatest(F.lit(0.45), F.col("agg_neutral"), F.least(F.col("confidence"), conf))
    return noted(v, F.when(~ok, CALIBRATED)).withColumn("confidence", F.when(ok, F.col("confidence")).otherwise(lower)).withColumn("verdict", F.when(ok, F.col("verdict")).otherwise("neutral"))


def percent(c: Column) -> Column:
    return F.concat(F.bround(c * 100, 0).cast("int").cast("string"), F.lit("%"))


# The sentences of a verdict's reasons. Those of support and refute are for high, moderate and low confidence.
COUNT = "Analyzed {} evidence sources."
CONFLICT = "Conflicting evidence detected from different sources."
SUPPORT = ["Strong evidence supports this claim.", "Moderate evidence supports this claim.", "Weak evidence leans toward supporting this claim."]
REFUTE = ["Strong evidence refutes this claim.", "Moderate evidence refutes this claim.", "Weak evidence suggests this claim may be inaccurate."]
CONTRADICTORY, INSUFFICIENT, MIXED = "Evidence is contradictory, no clear conclusion.", "Insufficient evidence to reach a conclusion.", "Evidence is inconclusive or mixed."
CLOSING = ["High confidence ({}).", "Moderate confidence ({}).", "Low confidence ({}). Further verification recommended."]


def reasoning() -> Column:
    """The reasons for a verdict, on the columns that `verdict` makes."""
    c, v, k = F.col("confidence"), F.col("verdict"), F.col("evidence_count")
    level = lambda three: F.when(c >= 0.75, three[0]).when(c >= 0.55, three[1]).otherwise(three[2])
    filled = lambda text, value: F.replace(text, F.lit("{}"), value)
    shares = F.concat_ws(", ", *[F.concat(F.lit(f"{k.capitalize()}: "), percent(F.col(f"agg_{k}"))) for k in ("support", "refute", "neutral")])
    neutral = F.when(F.col("conflict"), CONTRADICTORY).when(k < 2, INSUFFICIENT).otherwise(MIXED)
    what = F.when(v == "support", level(SUPPORT)).when(v == "refute", level(REFUTE)).otherwise(neutral)
    return F.concat_ws(" ", filled(F.lit(COUNT), k.cast("string")), F.when(F.col("conflict"), CONFLICT), F.concat(shares, F.lit(".")), what, filled(level(CLOSING), percent(c)))


def weak_neutral(evidence: DataFrame, by: str, o: Options = Options()) -> DataFrame:
    """by, n_good, weak: whether neutral lacks enough relevant and credible neutral rows."""
    good = (F.col("stance") == "neutral") & (F.col("relevance") >= o.neutral_relevance) & (F.col("credibility") >= o.neutral_credibility)
    return evidence.groupBy(by).agg(F.count_if(good).alias("n_good")).withColumn("weak", F.col("n_good") < o.neutral_count)


def escalation(evidence: DataFrame, by: str, trusted: Column, prescore: Column, url: str = "url", hosts: int = 3, hits: int = 1, mean: float = 0.10) -> DataFrame:
    """by, n_hosts, n_trusted, mean_prescore, weak: whether the pool needs the paid search."""
    h = host(url)
    out = evidence.groupBy(by).agg(F.count_distinct(F.when(h != "", h)).alias("n_hosts"), F.count_if(trusted & (h != "")).alias("n_trusted"), (total(prescore) / F.count("*")).alias("mean_prescore"))
    return out.withColumn("weak", (F.col("n_hosts") < hosts) | (F.col("n_trusted") < hits) | (F.col("mean_prescore") < mean))


def corroboration(evidence: DataFrame, by: str, span: Column, number: Column, date: Column, url: str = "url") -> DataFrame:
    """evidence with corroboration_hosts and corroboration_score: distinct hosts that say the same within a claim."""
    key = F.trim(F.concat_ws(" ", F.substring(F.lower(span), 1, 180), F.substring(F.lower(number), 1, 40), F.substring(F.lower(date), 1, 40)))
    e = evidence.withColumn("_key", key)
    h = host(url)
    n = e.where("_key <> ''").groupBy(by, "_key").agg(F.count_distinct(F.when(h != "", h)).alias("corroboration_hosts"))
    out = e.join(n, [by, "_key"], "left").drop("_key")
    return out.withColumn("corroboration_score", F.least(F.lit(0.15), F.greatest(F.lit(0.0), (F.col("corroboration_hosts") - 1) * 0.08)))


def apply_updates(evidence: DataFrame, updates: DataFrame, by: str, idx: str, old: str, new: str, share: float | None = None) -> DataFrame:
    """evidence with `old` replaced where an update (by, idx, new) exists, or blended with the share of the old value.

    The first of updates for a row counts, by their column _n; several without one raise. Bad indices meet no row.
    """
    some = updates.where(F.col(new).isNotNull()).groupBy(by, idx)
    alone = F.when(F.count("*") > 1, F.raise_error(F.lit("several updates of one row need their order, _n"))).otherwise(F.min(new))
    first = some.agg((F.min_by(new, "_n") if "_n" in updates.columns else alone).alias("_new"))
    out = evidence.join(first, [by, idx], "left")
    changed = F.col("_new") if share is None else F.col(old) * share + F.col("_new") * (1 - share)
    return out.withColumn(old, F.when(F.col("_new").isNull(), F.col(old)).otherwise(changed)).drop("_new")
