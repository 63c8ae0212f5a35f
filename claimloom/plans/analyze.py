"""Claims and retrieved rows to verdicts: every stage in order, one plan for a whole batch."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.urls import Policy, blocked, host
from ..functions.values import CREDIBILITY, NEUTRAL_CUES, POLARITY_REFUTE, POLARITY_SUPPORT, REFUTE_CUES, SUPPORT_CUES
from ..operators import classify, scoring, selection, verdict
from ..operators.evidence import normalize


@dataclass(frozen=True)
class Settings:
    policy: Policy = Policy()
    bypass: tuple[str, ...] = ()
    pool: int = 30
    keep: int = 10
    per_host: int = 3
    relevance: float = 0.30
    min_keep: int = 3
    min_keep_multi: int = 5
    credibility: tuple = tuple(CREDIBILITY)
    support: tuple[str, ...] = tuple(SUPPORT_CUES)
    refute: tuple[str, ...] = tuple(REFUTE_CUES)
    neutral: tuple[str, ...] = tuple(NEUTRAL_CUES)
    verdicts: verdict.Options = field(default_factory=verdict.Options)
    as_of: str = "2026-01-01"


def gathered(claims: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """Evidence rows (claim_id, pos, text, url, title, source, score, type, ...) of checkable claims: normalised, allowed by the
    policy, each source once, the best `pool` by quality. Filters come first, so that little is shuffled."""
    e = normalize(rows, ["claim_id", "pos"]).where(~blocked("url", s.policy))
    e = e.join(claims.where("ok").select("claim_id"), "claim_id", "left_semi")
    e = selection.first_per_key(e, ["claim_id"], selection.evidence_key(240), ["pos"])
    quality = scoring.quality_score(F.col("type"), F.col("score"), F.col("text"), F.col("url"))
    return selection.top(e.withColumn("quality_score", quality), ["claim_id"], [F.desc("quality_score"), "pos"], s.pool)


def scored(claims: DataFrame, evidence: DataFrame, s: Settings) -> DataFrame:
    """Evidence with relevance, stance, credibility, weight and tier, as the verdict takes it."""
    e = evidence.join(claims.select("claim_id", "claim", "english"), "claim_id")
    e = e.withColumn("relevance", scoring.keyword_relevance("claim", "text"))
    order = [F.desc("relevance"), "pos"]
    e = selection.first_per_key(e, ["claim_id"], selection.evidence_key(220), order)
    e = selection.relevance_floor(e, ["claim_id"], order, least=s.relevance, min_keep=F.when(F.col("english"), s.min_keep).otherwise(s.min_keep_multi))
    e = selection.by_host(e, ["claim_id"], s.per_host, order)
    e = selection.top(e, ["claim_id"], order, s.keep)
    e = e.withColumn("p", scoring.keyword_stance("claim", "text", s.support, s.refute, s.neutral))
    e = e.withColumn("p", scoring.polarity("claim", "title", "text", "p", support=POLARITY_SUPPORT, refute=POLARITY_REFUTE)).withColumn("stance", scoring.stance_label(F.col("p")))
    e = e.withColumn("credibility", scoring.lifted(scoring.credibility(table=list(s.credibility)), F.col("relevance")))
    old = scoring.temporal_weight(F.col("published_at"), F.col("relevance"), F.lit("GENERAL_FACTUAL"), s.as_of)
    e = e.withColumn("evidence_weight", F.col("relevance") * F.col("credibility") * old * scoring.tier_multiplier())
    lane = scoring.lane(F.col("type"), F.when(X.english_like("text"), "en").otherwise("multi"))
    e = e.withColumn("evidence_weight", F.when(F.col("english"), F.col("evidence_weight")).otherwise(F.col("evidence_weight") * scoring.lane_weight(lane)))
    eff = scoring.effective_relevance(F.col("relevance"), scoring.selector_score(F.col("quality_score")))
    e = e.withColumn("evidence_tier", scoring.evidence_tier(eff, F.col("credibility")))
    e = selection.drop_rejected(e.withColumn("structured", F.col("english")), ["claim_id"], "pos")
    e = selection.best_per_key(e, ["claim_id"], selection.scored_key(), "evidence_weight", "pos")
    return e.withColumn("weighted", scoring.weighted_stance(F.col("p"), F.col("evidence_weight")))


def decided(claims: DataFrame, e: DataFrame, s: Settings) -> DataFrame:
    """claim_id, verdict, confidence, evidence_count, reason, reasoning: verdict, for other languages the decisive rule and
    the quality gate, then calibration. The reasons are those of the first verdict; each later stage that acts adds its own."""
    o = s.verdicts
    agg = e.groupBy("claim_id").agg(*verdict.sum_columns(), *verdict.decisive_columns(o), verdict.gate_column(o))
    v = verdict.verdict(agg, o).withColumn("reasoning", verdict.reasoning()).join(claims.select("claim_id", "english"), "claim_id")
    v = verdict.abstain(verdict.decide(v, ~F.col("english"), o), ~F.col("english"), o)
    v = verdict.calibrate(v, F.col("english"), o)
    out = verdict.with_missing(claims.select("claim_id", "ok", "reason"), v.drop("english"), "claim_id", F.col("ok"))
    return out.select("claim_id", "verdict", F.round("confidence", 6).alias("confidence"), "evidence_count", "reason", F.coalesce("reasoning", F.lit("")).alias("reasoning"))


def analyze(claims: DataFrame, rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A result for each of claims(claim_id, claim, lang) from retrieved rows(claim_id, pos, and whatever providers give)."""
    c = claims.withColumn("check", classify.checkability("claim", "lang", s.bypass)).select("claim_id", X.clean_claim("claim").alias("claim"), F.lower(F.coalesce("lang", F.lit("en"))).startswith("en").alias("english"), "check.ok", "check.reason")
    return decided(c, scored(c, gathered(c, rows, s), s), s)


def telemetry(e: DataFrame) -> DataFrame:
    """claim_id, rows, hosts, types of gathered evidence."""
    h = host("url")
    return e.groupBy("claim_id").agg(F.count("*").alias("rows"), F.count_distinct(F.when(h != "", h)).alias("hosts"), F.count_distinct("type").alias("types"))
