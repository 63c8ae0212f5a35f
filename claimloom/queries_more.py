"""Further queries: joins, scores, verdicts, datasets, evaluation, streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as X
from .functions import urls as U
from .functions.values import OPINION
from .operators import classify as C
from .operators import dataset as D
from .operators import evaluate as E
from .operators import scoring as S
from .operators import selection as K
from .operators import verdict as V
from .plans import verify
from .queries import DOWN, EV, EVEN, PIECES, SENTENCES, TABLE, UP, evidence, query, t, tok, words
from .streaming import limits as L

# scores ------------------------------------------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
_REL = f"CASE WHEN len(b) = 0 THEN 0.3 ELSE least(1.0, len(list_intersect(a, b))::DOUBLE / len(b) * 1.5) END"


@query("s1_keyword_relevance", EV + f"SELECT pos, round({_REL}, 6) AS relevance FROM (SELECT pos, list_filter({words('text')}, lambda w: NOT list_contains({_STOP}, w)) AS a, list_filter({words('claim')}, lambda w: NOT list_contains({_STOP}, w)) AS b FROM ev)")
def s1(spark, sf):
    return evidence(spark, sf).select("pos", F.round(S.keyword_relevance("claim", "text"), 6).alias("relevance"))


@query("s2_embedding_relevance", "SELECT a.vec_id AS claim_id, b.vec_id, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 4) AS relevance FROM embeddings b JOIN (SELECT label, min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) a ON a.label IS NOT DISTINCT FROM b.label")
def s2(spark, sf):
    e = t(spark, sf, "embeddings")
    q = e.groupBy(F.col("label").alias("claim_label")).agg(F.min("vec_id").alias("claim_id"), F.min_by("embedding", "vec_id").alias("q"))
    both = e.join(q, F.col("label").eqNullSafe(F.col("claim_label")))
    return both.select("claim_id", "vec_id", F.round(S.embedding_relevance(F.col("q"), F.col("embedding")), 4).alias("relevance"))


def _cues(ks: list[str]) -> str:
    return "(" + " + ".join(f"contains(l, '{k}')::INTEGER" for k in ks) + ")"


_STANCE = f"(SELECT *, s / tt AS ps, r / tt AS pr, n / tt AS pn FROM (SELECT *, s + r + n + 0.1::DOUBLE AS tt FROM (SELECT *, {_cues(UP)}::DOUBLE + CASE WHEN o > 3 THEN o * 0.3::DOUBLE ELSE 0 END AS s, {_cues(DOWN)}::DOUBLE AS r, {_cues(EVEN)}::DOUBLE AS n FROM (SELECT *, lower(text) AS l, len(list_intersect({words('text')}, {words('claim')})) AS o FROM ev))))"


@query("s4_keyword_stance", EV + f"SELECT pos, round(ps, 6) AS support, round(pr, 6) AS refute, round(pn, 6) AS neutral, CASE WHEN ps >= pr AND ps >= pn THEN 'support' WHEN pr >= pn THEN 'refute' ELSE 'neutral' END AS stance FROM {_STANCE}")
def s4(spark, sf):
    e = evidence(spark, sf).withColumn("k", S.keyword_stance("claim", "text", UP, DOWN, EVEN))
    return e.select("pos", *[F.round(F.col(f"k.{c}"), 6).alias(c) for c in ("support", "refute", "neutral")], S.stance_label(F.col("k")).alias("stance"))


@query("s7_polarity", EV + f"""
SELECT pos, round(CASE WHEN act AND u > d THEN sup + tk ELSE sup END, 6) AS support, round(CASE WHEN act AND d > u THEN ref + tk ELSE ref END, 6) AS refute, round(CASE WHEN act AND u <> d THEN neu - tk ELSE neu END, 6) AS neutral
FROM (SELECT *, NOT (u > 0 AND d > 0) AND neu >= greatest(sup, ref) AND relevance >= 0.5 AND (len(b) = 0 OR list_has_any(a, b)) AS act, least(0.12, greatest(0, neu - 0.2)) AS tk
  FROM (SELECT *, {_cues(UP)} AS u, {_cues(DOWN)} AS d, {tok('l')} AS a, {tok('claim')} AS b FROM (SELECT *, lower(title || ' ' || text) AS l FROM ev)))
""")
def s7(spark, sf):
    e = evidence(spark, sf).withColumn("q", S.polarity("claim", "title", "text", "p", least_relevance=0.5, support=UP, refute=DOWN))
    return e.select("pos", *[F.round(F.col(f"q.{c}"), 6).alias(c) for c in ("support", "refute", "neutral")])


_CRED = "CASE " + " ".join(f"WHEN contains(lower(source), '{k}') OR contains(lower(url), '{k}') THEN {v}::DOUBLE" for k, v in TABLE) + " END"


@query("j3_credibility", EV + f"SELECT pos, CASE WHEN type = 'structured_api' THEN 0.9 ELSE coalesce({_CRED}, CASE WHEN type = 'web_search' THEN 0.7 ELSE 0.5 END) END::DOUBLE AS credibility FROM ev")
def j3(spark, sf):
    return evidence(spark, sf).select("pos", S.credibility(table=TABLE).alias("credibility"))


@query("j4_simple_credibility", "SELECT doc_id, CASE WHEN contains(source, 'src1') THEN 0.9 ELSE 0.7 END::DOUBLE AS weight FROM documents")
def j4(spark, sf):
    return t(spark, sf, "documents").select("doc_id", S.simple_credibility(F.col("source"), TABLE).alias("weight"))


@query("s11_tier_multiplier", EV + "SELECT pos, CASE WHEN contains(source || ' ' || host || ' ' || lower(url), 'example.com') THEN 1.05 WHEN contains(source || ' ' || host || ' ' || lower(url), 'blog') THEN 0.80 WHEN regexp_matches(lower(url), '/questions?/|/qna/|/forum/|/community/|/comments?/|/threads?/') THEN 0.85 ELSE 1.0 END::DOUBLE AS tier FROM ev")
def s11(spark, sf):
    return evidence(spark, sf).select("pos", S.tier_multiplier(high=["example.com"], low=["blog"]).alias("tier"))


@query("s12_temporal", """
SELECT event_id, round(CASE WHEN h > 500 THEN 1.0 ELSE greatest(0.4, least(1.0, w + CASE WHEN r >= 0.95 THEN 0.35 WHEN r >= 0.90 THEN 0.25 WHEN r >= 0.80 THEN 0.10 ELSE 0 END)) END, 6) AS weight
FROM (SELECT event_id, r, h, pow(0.5::DOUBLE, (date_diff('day', ts::DATE, DATE '2030-01-01')::DOUBLE / 30.44::DOUBLE) / h) AS w FROM (SELECT event_id, ts, (event_id % 101)::DOUBLE / 100 AS r, CASE event_id % 3 WHEN 0 THEN 36 WHEN 1 THEN 60 ELSE 999 END AS h FROM events))
""")
def s12(spark, sf):
    e = t(spark, sf, "events")
    ctx = F.when(F.col("event_id") % 3 == 0, "SCIENCE").when(F.col("event_id") % 3 == 1, "LAW_CRIME").otherwise("HISTORY")
    w = S.temporal_weight(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), (F.col("event_id") % 101) / F.lit(100.0), ctx, "2030-01-01")
    return e.select("event_id", F.round(w, 6).alias("weight"))


_W = f"(SELECT *, relevance * CASE WHEN relevance >= 0.95 AND c < 0.82 THEN least(0.82::DOUBLE, c + 0.15::DOUBLE) ELSE c END AS w, CASE WHEN relevance >= 0.95 AND c < 0.82 THEN least(0.82::DOUBLE, c + 0.15::DOUBLE) ELSE c END AS cr FROM (SELECT *, (CASE WHEN type = 'structured_api' THEN 0.9 ELSE coalesce({_CRED}, CASE WHEN type = 'web_search' THEN 0.7 ELSE 0.5 END) END)::DOUBLE AS c FROM ev))"


def weighed(spark, sf):
    """Evidence with credibility, evidence_weight and weighted stance; no date and no tier, so their factors are 1."""
    e = evidence(spark, sf).withColumn("c", S.credibility(table=TABLE))
    one = F.lit(1.0)
    e = e.withColumn("evidence_weight", S.weight(F.col("relevance"), F.col("c"), one, one)).withColumn("credibility", S.lifted(F.col("c"), F.col("relevance")))
    return e.withColumn("weighted", S.weighted_stance(F.col("p"), F.col("evidence_weight"))).withColumn("stance", S.stance_label(F.col("p")))


@query("s8_weight", EV + f"SELECT pos, round(w, 6) AS weight, round(sup * w, 6) AS support, round(ref * w, 6) AS refute, round(neu * w, 6) AS neutral, round(0.55 * relevance + 0.25 * c + 0.20 * greatest(sup, ref, neu), 6) AS hybrid, round(least(1, 0.5 * relevance + 0.3 * greatest(sup, ref, neu) + 0.2 * c), 6) AS research FROM {_W}")
def s8(spark, sf):
    conf = F.greatest("p.support", "p.refute", "p.neutral")
    e = weighed(spark, sf)
    return e.select("pos", F.round("evidence_weight", 6).alias("weight"), *[F.round(F.col(f"weighted.{k}"), 6).alias(k) for k in ("support", "refute", "neutral")], F.round(S.hybrid_rank(F.col("relevance"), F.col("c"), conf), 6).alias("hybrid"), F.round(S.research_weight(F.col("relevance"), conf, F.col("c")), 6).alias("research"))


@query("s14_tiers", EV + f"SELECT pos, round(e, 6) AS effective, CASE WHEN e >= 0.45 AND c >= 0.40 THEN 'strong' WHEN e >= 0.30 AND c >= 0.25 THEN 'soft' ELSE 'reject' END AS tier, lane, CASE lane WHEN 'structured_reference' THEN 1.10 WHEN 'translated_en' THEN 0.92 ELSE 1.00 END::DOUBLE AS lane_weight FROM (SELECT *, least(1.0::DOUBLE, relevance * 0.85::DOUBLE + (CASE WHEN score = 0 THEN 50 ELSE score * 100 END / 100)::DOUBLE * 0.15::DOUBLE) AS e, CASE WHEN type = 'structured_api' THEN 'structured_reference' WHEN lang = 'en' THEN 'translated_en' ELSE 'native_local' END AS lane FROM {_W})")
def s14(spark, sf):
    e = weighed(spark, sf)
    eff = S.effective_relevance(F.col("relevance"), S.selector_score(F.col("score") * 100))
    ln = S.lane(F.col("type"), F.col("lang"))
    return e.select("pos", F.round(eff, 6).alias("effective"), S.evidence_tier(eff, F.col("c")).alias("tier"), ln.alias("lane"), S.lane_weight(ln).alias("lane_weight"))


@query("s16_scrape_scores", EV + f"""
SELECT pos, round(CASE WHEN type = 'scraping' AND q >= 0.62 THEN least(1, relevance + 0.08) ELSE relevance END, 6) AS boosted, round(score + least(length(text), 4000)::DOUBLE / 4000 + 0.05 + 0.8 * o, 6) AS quality, round(least(0.92, greatest(0.35, 0.5 + least(0.18, 0.22 * o) + CASE WHEN q >= 0.62 THEN 0.08 ELSE 0 END)), 6) AS dynamic
FROM (SELECT *, score AS q, CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / len(b) END AS o FROM (SELECT *, {tok('text')} AS a, {tok('claim')} AS b FROM ev))
""")
def s16(spark, sf):
    e = evidence(spark, sf).withColumn("o", X.overlap_ratio(X.token_set("text"), X.token_set("claim"))).withColumn("structured", F.col("score") >= 0.62)
    zero = F.lit(0.0)
    return e.select("pos", F.round(S.structured_boost(F.col("type"), F.col("structured"), F.col("score"), F.col("relevance")), 6).alias("boosted"), F.round(S.scrape_quality(F.col("score"), F.col("text"), F.col("title"), F.col("o"), zero), 6).alias("quality"), F.round(S.scraped_credibility(F.lit(""), F.col("o"), F.col("structured"), zero, zero), 6).alias("dynamic"))


@query("s19_domain_weight", "SELECT page_id, least(1.0::DOUBLE, (page_id % 101)::DOUBLE / 100 * CASE WHEN contains(u, 'casino') THEN 0.8 WHEN contains(u, 'blog') THEN 1.1 ELSE 1.0 END::DOUBLE) AS weight FROM (SELECT page_id, lower(url) AS u FROM pages)")
def s19(spark, sf):
    d = F.when(F.contains("url", F.lit("casino")), "social").when(F.contains("url", F.lit("blog")), "science").otherwise("")
    return t(spark, sf, "pages").select("page_id", S.domain_weight((F.col("page_id") % 101) / F.lit(100.0), d).alias("weight"))


@query("a28_weighted_score", "SELECT p_partkey, round(least(1, greatest(0, ((p_partkey % 7)::DOUBLE / 7 * 2 + (p_size::DOUBLE / 50) * 1) / 3)), 6) AS score FROM part")
def a28(spark, sf):
    scores = F.create_map(F.lit("a"), (F.col("p_partkey") % 7) / F.lit(7.0), F.lit("b"), F.col("p_size") / F.lit(50.0))
    return t(spark, sf, "part").select("p_partkey", F.round(S.weighted_score(scores, F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0))), 6).alias("score"))


def _claim_score(c: str) -> str:
    """claim_score in SQL, for a sentence without white space at its ends."""
    edge = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    hit = lambda p, v: f"CASE WHEN {p} THEN {v} ELSE 0 END"
    some = lambda ws: "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"
    like = lambda p: f"regexp_matches({c}, '{p}')"
    parts = [
        hit(like(rf"{edge[0]}(?:19|20)\d{{2}}{edge[1]}"), 2.0), hit(like(rf"{edge[0]}\d+{edge[1]}|%"), 1.5), hit(some(S.REPORT_WORDS), 1.0), hit(like(rf"{edge[0]}[A-Z][a-z]+{edge[1]}"), 1.0), hit(some(S.IMPACT_WORDS), 1.8),
        hit(like(rf"{edge[0]}(?:on|in)\s+\d{{1,2}}\s+[A-Za-z]{{3,9}}\s+\d{{4}}{edge[1]}"), 1.2), hit(some(S.HEADING_WORDS), -2.0), hit(like(r"^[A-Z][A-Za-z\s:,-]{0,120}$"), -1.2),
        rf"greatest(0.0::DOUBLE, 1.0::DOUBLE - abs(len(list_filter(string_split(trim(regexp_replace({c}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')) - 28) / 40.0::DOUBLE)",
    ]
    return " + ".join(parts)


@query("k6_claim_scores", f"SELECT doc_id, pos, round(({_claim_score('sentence')})::DOUBLE, 6) AS score FROM (SELECT doc_id, generate_subscripts(s, 1)::INTEGER - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents))")
def k6(spark, sf):
    s = t(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("pos", "sentence"))
    return s.select("doc_id", "pos", F.round(S.claim_score("sentence"), 6).alias("score"))


# verdicts ----------------------------------------------------------------------------------------------------------------

_SUM = "sum({0}::DECIMAL(30,12))::DOUBLE"
_AGG = f"(SELECT claim_id, {_SUM.format('sup * w')} / {_SUM.format('w')} AS s, {_SUM.format('ref * w')} / {_SUM.format('w')} AS r, {_SUM.format('neu * w')} / {_SUM.format('w')} AS n, count(*) AS k FROM {_W} GROUP BY claim_id)"
_VERDICT = f"(SELECT *, CASE WHEN cf THEN 'neutral' WHEN s > r AND s > n THEN 'support' WHEN r > s AND r > n THEN 'refute' ELSE 'neutral' END AS v, CASE WHEN cf THEN least(greatest(n, 0.5), 0.7) * m WHEN s > r AND s > n THEN s * m WHEN r > s AND r > n THEN r * m ELSE n * m END AS c FROM (SELECT *, s > 0.40 AND r > 0.40 AS cf, CASE WHEN k < 2 THEN 0.75 WHEN k <= 3 THEN 0.85 ELSE 1.0 END AS m FROM {_AGG}))"


@query("a1_verdict", EV + f"SELECT claim_id, v AS verdict, round(c, 6) AS confidence, k AS evidence_count, cf AS conflict FROM {_VERDICT}")
def a1(spark, sf):
    v = V.verdict(V.sums(weighed(spark, sf), "claim_id"))
    return v.select("claim_id", "verdict", F.round("confidence", 6).alias("confidence"), "evidence_count", "conflict")


def _percent(c: str) -> str:
    return f"round_even({c} * 100, 0)::INTEGER || '%'"


def _level(three: list[str]) -> str:
    return f"CASE WHEN c >= 0.75 THEN '{three[0]}' WHEN c >= 0.55 THEN '{three[1]}' ELSE '{three[2]}' END"


_REASONS = f"""replace('{V.COUNT}', '{{}}', k::VARCHAR) || CASE WHEN cf THEN ' {V.CONFLICT}' ELSE '' END || ' Support: ' || {_percent('s')} || ', Refute: ' || {_percent('r')} || ', Neutral: ' || {_percent('n')} || '. '
  || CASE v WHEN 'support' THEN {_level(V.SUPPORT)} WHEN 'refute' THEN {_level(V.REFUTE)} ELSE CASE WHEN cf THEN '{V.CONTRADICTORY}' WHEN k < 2 THEN '{V.INSUFFICIENT}' ELSE '{V.MIXED}' END END || ' ' || replace({_level(V.CLOSING)}, '{{}}', {_percent('c')})"""


@query("a2_reasoning", EV + f"SELECT claim_id, {_REASONS} AS reasoning FROM {_VERDICT}")
def a2(spark, sf):
    return V.verdict(V.sums(weighed(spark, sf), "claim_id")).select("claim_id", V.reasoning().alias("reasoning"))


_TIER = "CASE WHEN relevance >= 0.45 AND c >= 0.40 THEN 'strong' WHEN relevance >= 0.30 AND c >= 0.25 THEN 'soft' ELSE 'reject' END"
_LABEL = "CASE WHEN sup >= ref AND sup >= neu THEN 'support' WHEN ref >= neu THEN 'refute' ELSE 'neutral' END"


def tiered(spark, sf):
    return weighed(spark, sf).withColumn("evidence_tier", S.evidence_tier(F.col("relevance"), F.col("c")))


@query("a3_decisive", EV + f"""
, z AS (SELECT *, {_TIER} AS tier, {_LABEL} AS st FROM {_W}),
d AS (SELECT claim_id, {_SUM.format("CASE WHEN st = 'support' THEN w * f ELSE 0 END")} AS s, {_SUM.format("CASE WHEN st = 'refute' THEN w * f ELSE 0 END")} AS r, count(*) FILTER (WHERE tier = 'strong' AND st <> 'neutral') AS strong_count FROM (SELECT *, CASE tier WHEN 'strong' THEN 1.0 WHEN 'soft' THEN 0.6 ELSE 0 END::DOUBLE AS f FROM z) GROUP BY claim_id)
SELECT v.claim_id, CASE WHEN weak THEN 'neutral' WHEN d.s > d.r THEN 'support' ELSE 'refute' END AS verdict, round(CASE WHEN weak THEN greatest(c, 0.45) ELSE greatest(c, least(0.99, greatest(0.5, abs(d.s - d.r) / greatest(d.s + d.r, 1e-6)))) END, 6) AS confidence
FROM {_VERDICT} v JOIN (SELECT *, strong_count = 0 OR s + r < 0.35 OR abs(s - r) < 0.15 AS weak FROM d) d ON v.claim_id = d.claim_id
""")
def a3(spark, sf):
    e = tiered(spark, sf)
    v = V.apply_decisive(V.verdict(V.sums(e, "claim_id")), V.decisive(e, "claim_id"), "claim_id")
    return v.select("claim_id", "verdict", F.round("confidence", 6).alias("confidence"))


@query("a5_quality_gate", EV + f"""
, z AS (SELECT *, {_TIER} AS tier, {_LABEL} AS st FROM {_W}),
g AS (SELECT claim_id, (count(*) < 4)::INTEGER + (count(*) FILTER (WHERE st <> 'neutral') < 2)::INTEGER + (count(DISTINCT CASE WHEN host <> '' THEN host END) < 2)::INTEGER + (count(DISTINCT type) < 1)::INTEGER + (count(*) FILTER (WHERE st <> 'neutral' AND tier = 'strong') < 1)::INTEGER
  + (coalesce({_SUM.format("CASE WHEN st <> 'neutral' THEN relevance END")} / count(*) FILTER (WHERE st <> 'neutral'), 0) < 0.5)::INTEGER + (coalesce({_SUM.format("CASE WHEN st <> 'neutral' THEN cr END")} / count(*) FILTER (WHERE st <> 'neutral'), 0) < 0.4)::INTEGER AS failed FROM z GROUP BY claim_id)
SELECT claim_id, failed::BIGINT AS failed FROM g
""")
def a5(spark, sf):
    return V.gate(tiered(spark, sf), "claim_id")


@query("a4_calibration", EV + f"""
SELECT claim_id, CASE WHEN v <> 'neutral' AND NOT ok THEN 'neutral' ELSE v END AS verdict, round(CASE WHEN v <> 'neutral' AND NOT ok THEN greatest(0.45, n, least(c, mc)) ELSE c END, 6) AS confidence
FROM (SELECT *, c >= mc AND abs(s - r) >= mg AS ok FROM (SELECT *, CASE WHEN claim_id % 2 = 0 THEN 0.55 ELSE 0.60 END AS mc, CASE WHEN claim_id % 2 = 0 THEN 0.08 ELSE 0.12 END AS mg FROM {_VERDICT}))
""")
def a4(spark, sf):
    v = V.calibrate(V.verdict(V.sums(weighed(spark, sf), "claim_id")), F.col("claim_id") % 2 == 0)
    return v.select("claim_id", "verdict", F.round("confidence", 6).alias("confidence"))


@query("a_whole_verdict", EV + f"""
, z AS (SELECT *, {_TIER} AS tier, {_LABEL} AS st FROM {_W}),
d AS (SELECT claim_id, {_SUM.format("CASE WHEN st = 'support' THEN w * f ELSE 0 END")} AS ds, {_SUM.format("CASE WHEN st = 'refute' THEN w * f ELSE 0 END")} AS dr, count(*) FILTER (WHERE tier = 'strong' AND st <> 'neutral') AS strong_count FROM (SELECT *, CASE tier WHEN 'strong' THEN 1.0 WHEN 'soft' THEN 0.6 ELSE 0 END::DOUBLE AS f FROM z) GROUP BY claim_id),
g AS (SELECT claim_id, (count(*) < 4)::INTEGER + (count(*) FILTER (WHERE st <> 'neutral') < 2)::INTEGER + (count(DISTINCT CASE WHEN host <> '' THEN host END) < 2)::INTEGER + (count(DISTINCT type) < 1)::INTEGER + (count(*) FILTER (WHERE st <> 'neutral' AND tier = 'strong') < 1)::INTEGER
  + (coalesce({_SUM.format("CASE WHEN st <> 'neutral' THEN relevance END")} / count(*) FILTER (WHERE st <> 'neutral'), 0) < 0.5)::INTEGER + (coalesce({_SUM.format("CASE WHEN st <> 'neutral' THEN cr END")} / count(*) FILTER (WHERE st <> 'neutral'), 0) < 0.4)::INTEGER AS failed FROM z GROUP BY claim_id),
x AS (SELECT v.*, d.*, strong_count = 0 OR ds + dr < 0.35 OR abs(ds - dr) < 0.15 AS weak, failed FROM (SELECT *, {_REASONS} AS why FROM {_VERDICT}) v JOIN d ON v.claim_id = d.claim_id JOIN g ON g.claim_id = v.claim_id),
y AS (SELECT *, CASE WHEN weak THEN 'neutral' WHEN ds > dr THEN 'support' ELSE 'refute' END AS v1, CASE WHEN weak THEN greatest(c, 0.45) ELSE greatest(c, least(0.99, greatest(0.5, abs(ds - dr) / greatest(ds + dr, 1e-6)))) END AS c1, why || CASE WHEN weak THEN ' {V.NOT_DECISIVE}' ELSE ' {V.DECISIVE}' END AS why1 FROM x),
q AS (SELECT *, v1 <> 'neutral' AND failed >= 2 AS stop FROM y),
u AS (SELECT *, CASE WHEN stop THEN 'neutral' ELSE v1 END AS v2, CASE WHEN stop THEN least(0.65, greatest(0.45, c1)) ELSE c1 END AS c2, why1 || CASE WHEN stop THEN ' {V.GATED}' ELSE '' END AS why2 FROM q),
o AS (SELECT *, v2 = 'neutral' OR (c2 >= 0.60 AND abs(s - r) >= 0.12) AS ok FROM u)
SELECT b.item_id AS claim_id, CASE WHEN v2 IS NULL OR NOT ok THEN 'neutral' ELSE v2 END AS verdict, round(CASE WHEN v2 IS NULL THEN 0.3 WHEN ok THEN c2 ELSE greatest(0.45, n, least(c2, 0.60)) END, 6) AS confidence, coalesce(k, 0) AS evidence_count, why2 || CASE WHEN ok THEN '' ELSE ' {V.CALIBRATED}' END AS reasoning
FROM benchmark b LEFT JOIN o ON o.claim_id = b.item_id
""")
def a_whole(spark, sf):
    e = tiered(spark, sf)
    v = V.verdict(V.sums(e, "claim_id")).withColumn("reasoning", V.reasoning())
    v = V.apply_gate(V.apply_decisive(v, V.decisive(e, "claim_id"), "claim_id"), V.gate(e, "claim_id"), "claim_id")
    v = V.calibrate(v, F.lit(False))
    claims = t(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"))
    return V.with_missing(claims, v, "claim_id").select("claim_id", "verdict", F.round("confidence", 6).alias("confidence"), "evidence_count", "reasoning")


@query("a6_telemetry", EV + "SELECT claim_id, 'type' AS kind, type AS value, count(*) AS n FROM ev GROUP BY 1, 3 UNION ALL SELECT claim_id, 'lang', lang, count(*) FROM ev GROUP BY 1, 3 UNION ALL SELECT claim_id, 'host', host, n FROM (SELECT claim_id, host, n, row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, host) AS k FROM (SELECT claim_id, host, count(*) AS n FROM ev WHERE host <> '' GROUP BY 1, 2)) WHERE k <= 10")
def a6(spark, sf):
    e = evidence(spark, sf).withColumn("host", U.host("url"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("type", "type"), ("lang", "lang"), ("host", "host"))]))
    n = e.select("claim_id", kinds.alias("x")).where("x.value <> ''").groupBy("claim_id", "x.kind", "x.value").agg(F.count("*").alias("n"))
    return K.top(n, ["claim_id", "kind"], [F.desc("n"), "value"], 10)


@query("a7_corroboration", EV + """
, k AS (SELECT claim_id, pos, host, trim(substr(lower(source), 1, 180) || ' ' || lower(lang) || ' ' || '') AS key FROM ev), h AS (SELECT claim_id, key, count(DISTINCT CASE WHEN host <> '' THEN host END) AS n FROM k GROUP BY 1, 2)
SELECT pos, n AS hosts, round(least(0.15, greatest(0, 0.08 * (n - 1)))::DOUBLE, 6) AS score FROM k JOIN h ON k.claim_id = h.claim_id AND k.key = h.key
""")
def a7(spark, sf):
    c = V.corroboration(evidence(spark, sf), "claim_id", F.col("source"), F.col("lang"), F.lit(""))
    return c.select("pos", F.col("corroboration_hosts").alias("hosts"), F.round("corroboration_score", 6).alias("score"))


@query("p20_weak_neutral", EV + f"SELECT claim_id, count(*) FILTER (WHERE st = 'neutral' AND relevance >= 0.86 AND cr >= 0.65) AS n_good, count(*) FILTER (WHERE st = 'neutral' AND relevance >= 0.86 AND cr >= 0.65) < 2 AS weak FROM (SELECT *, {_LABEL} AS st FROM {_W}) GROUP BY claim_id")
def p20(spark, sf):
    return V.weak_neutral(weighed(spark, sf), "claim_id")


@query("p21_escalation", EV + f"""
SELECT claim_id, count(DISTINCT CASE WHEN host <> '' THEN host END) AS n_hosts, count(*) FILTER (WHERE host = 'example.com' OR host LIKE '%.example.com') AS n_trusted, round({_SUM.format("CASE WHEN len(b) = 0 THEN 0 ELSE least(1.0, len(list_intersect(a, b))::DOUBLE / len(b) * 1.4) END")} / count(*), 6) AS mean_prescore
FROM (SELECT *, {tok("title || ' ' || text")} AS a, {tok('claim')} AS b FROM ev) GROUP BY claim_id
""")
def p21(spark, sf):
    pre = S.prescore(X.token_set("claim"), X.token_set(F.concat_ws(" ", "title", "text")))
    e = V.escalation(evidence(spark, sf), "claim_id", U.in_domains(U.host("url"), ["example.com"]), pre)
    return e.select("claim_id", "n_hosts", "n_trusted", F.round("mean_prescore", 6).alias("mean_prescore"))


# joins -------------------------------------------------------------------------------------------------------------------

ROUTES = [("1-URGENT", "F", 1, "news"), ("1-URGENT", "_default", 1, "search"), ("2-HIGH", "_default", 1, "wiki"), ("2-HIGH", "_default", 2, "base"), ("GENERAL_FACTUAL", "_default", 1, "general")]
_ROUTE_ROWS = ", ".join(str(r) for r in ROUTES)


@query("j2_routes", f"""
WITH r AS (SELECT * FROM (VALUES {_ROUTE_ROWS}) v(l1, l2, p, s)), d AS (SELECT l1, l2, list(s ORDER BY p) AS s FROM r GROUP BY 1, 2)
SELECT o_orderkey, list_concat(s, list_filter(['base', 'more'], lambda x: NOT list_contains(s, x))) AS sources
FROM (SELECT o_orderkey, coalesce(a.s, b.s, g.s) AS s FROM orders o LEFT JOIN d a ON a.l1 = o.o_orderpriority AND a.l2 = o.o_orderstatus LEFT JOIN d b ON b.l1 = o.o_orderpriority AND b.l2 = '_default' JOIN d g ON g.l1 = 'GENERAL_FACTUAL')
""")
def j2(spark, sf):
    table = spark.createDataFrame(ROUTES, "level1 string, level2 string, pos int, source string")
    return C.route(t(spark, sf, "orders"), table, "o_orderpriority", "o_orderstatus", baseline=["base", "more"]).select("o_orderkey", "sources")


@query("j5_verifier_updates", EV + "SELECT pos, CASE WHEN pos % 7 = 0 THEN 0.98 ELSE sup END::DOUBLE AS support, CASE WHEN pos % 5 = 0 THEN round(relevance * 0.3 + 0.5 * 0.7, 6) ELSE round(relevance, 6) END::DOUBLE AS blended FROM ev")
def j5(spark, sf):
    e = evidence(spark, sf)
    u = e.where("pos % 7 = 0").select("claim_id", "pos", F.lit("support").alias("v"))
    b = e.where("pos % 5 = 0").select("claim_id", "pos", F.lit(0.5).alias("r"))
    e = V.apply_updates(e.withColumn("stance", F.lit("none")), u, "claim_id", "pos", "stance", "v")
    e = V.apply_updates(e, b, "claim_id", "pos", "relevance", "r", 0.3)
    support = F.when(F.col("stance") == "support", S.verified_stance(F.col("stance"))["support"]).otherwise(F.col("p.support"))
    return e.select("pos", support.alias("support"), F.round("relevance", 6).alias("blended"))


@query("j7_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'P') AS busy FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j7(spark, sf):
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders")
    c = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    p = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return c.join(p.withColumn("busy", F.lit(True)), "c_custkey", "left").withColumn("busy", F.coalesce("busy", F.lit(False)))


@query("j10_mismatched", "SELECT o_orderkey, o_orderpriority, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS other_key FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY md5('n:' || o_orderkey), o_orderkey)")
def j10(spark, sf):
    m = D.mismatched(t(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice", "n")
    return m.select("o_orderkey", "o_orderpriority", "other_key")


@query("j12_expected_recall", "SELECT o_orderkey, len(e) AS n_expected, len(list_intersect(e, g)) AS n_found, round(len(list_intersect(e, g))::DOUBLE / len(e), 6) AS recall FROM (SELECT l_orderkey AS o_orderkey, list_distinct(list(lower(l_returnflag || l_linestatus))) AS e, list_distinct(list(lower(l_returnflag || l_linestatus)) FILTER (WHERE l_linenumber % 2 = 0)) AS g FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber % 2 = 0) > 0)")
def j12(spark, sf):
    u = F.concat("l_returnflag", "l_linestatus")
    r = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(u).alias("e"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, u)).alias("g")).where("size(g) > 0")
    r = E.expected_recall(r, "e", "g")
    return r.select("o_orderkey", F.col("n_expected").cast("long").alias("n_expected"), F.col("n_found").cast("long").alias("n_found"), F.round("recall", 6).alias("recall"))


@query("j13_unit_costs", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 2.5 WHEN '2-HIGH' THEN 1.0 ELSE 0 END::DOUBLE AS cost FROM orders")
def j13(spark, sf):
    costs = spark.createDataFrame([("1-URGENT", 2.5), ("2-HIGH", 1.0)], "o_orderpriority string, cost double")
    return t(spark, sf, "orders").join(F.broadcast(costs), "o_orderpriority", "left").select("o_orderkey", F.coalesce("cost", F.lit(0.0)).alias("cost"))


@query("j14_compare_runs", "WITH a AS (SELECT o_orderpriority AS k, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderstatus AS k, count(*) AS v FROM orders GROUP BY 1 UNION ALL SELECT o_orderpriority, count(*) FROM orders WHERE o_orderpriority < '3' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.v AS value_a, b.v AS value_b, b.v - a.v AS delta FROM a FULL JOIN b ON a.k = b.k")
def j14(spark, sf):
    o = t(spark, sf, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("v"))
    b = o.groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("v")).union(o.where("o_orderpriority < '3'").groupBy("o_orderpriority").agg(F.count("*")))
    return E.compare_runs(a, b, ["k"], "v")


@query("j15_display_order", "SELECT place, k, n FROM (VALUES (1, '2-HIGH'), (2, 'missing'), (3, '1-URGENT')) v(place, k) LEFT JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) USING (k)")
def j15(spark, sf):
    n = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n"))
    return E.in_order(n, ["2-HIGH", "missing", "1-URGENT"], "k").select("place", "k", "n")


@query("j17_row_languages", "SELECT item_id, l AS lang FROM benchmark, (VALUES ('hi'), ('ta'), ('te')) v(l)")
def j17(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", F.explode(F.array(F.lit("hi"), F.lit("ta"), F.lit("te"))).alias("lang"))


# datasets ----------------------------------------------------------------------------------------------------------------


@query("w11_conflicts", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus, o_orderkey) AS k FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS n FROM orders)) WHERE k = 1")
def w11(spark, sf):
    return D.resolve_conflicts(t(spark, sf, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("w12_split", """
SELECT o_orderkey, CASE WHEN k <= nt THEN 'test' WHEN k <= nt + nv THEN 'val' ELSE 'train' END AS split FROM (SELECT *, CASE WHEN n = 1 THEN 0 ELSE greatest(1, round_even(n * 0.1, 0)) END AS nt, CASE WHEN n <= 2 THEN 0 ELSE greatest(1, round_even(n * 0.1, 0)) END AS nv FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('w:' || o_orderkey), o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders))
""")
def w12(spark, sf):
    return D.split(t(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "w").select("o_orderkey", "split")


@query("k19_balance", "SELECT doc_id FROM (SELECT d.doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('b:' || d.doc_id), d.doc_id) AS k FROM labels d) WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality, toxic))")
def k19(spark, sf):
    return D.balance(t(spark, sf, "labels"), ["quality", "toxic"], ["doc_id"], "b").select("doc_id")


@query("k19_balance_within", "SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY md5('b:' || doc_id), doc_id) AS k FROM labels) JOIN (SELECT quality, min(n) AS m FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality, toxic) GROUP BY quality) USING (quality) WHERE k <= m")
def k19b(spark, sf):
    return D.balance(t(spark, sf, "labels"), ["quality", "toxic"], ["doc_id"], "b", within=["quality"]).select("doc_id")


@query("k18_quotas", "SELECT doc_id, copy::INTEGER AS copy FROM (SELECT doc_id, unnest(range(1, ((q - k) // n + 2)::BIGINT)) AS copy FROM (SELECT *, CASE quality WHEN 1 THEN 500 ELSE 40 END AS q FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('q:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels)) WHERE k <= q)")
def k18(spark, sf):
    d = t(spark, sf, "labels").withColumn("label", F.col("quality").cast("string"))
    return D.to_quotas(d, "label", ["doc_id"], {"1": 500, "0": 40}, "q").select("doc_id", "copy")


@query("k20_augment", "SELECT n_nationkey, template, replace(template, '{}', n_name) AS made FROM nation, (VALUES ('Reports say {}.'), ('{}, it is said')) v(template) ORDER BY md5('a:' || n_nationkey || ':' || template), n_nationkey, template LIMIT 20")
def k20(spark, sf):
    a = D.augment(t(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name", ["Reports say {}.", "{}, it is said"], 20, ["n_nationkey"], "a")
    return a.select("n_nationkey", "template", "made")


@query("u4_split_overlap", "SELECT a.o_orderstatus AS part_a, b.o_orderstatus AS part_b, count(*) AS n FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders) a JOIN (SELECT DISTINCT o_orderstatus, o_custkey FROM orders) b ON a.o_custkey = b.o_custkey AND a.o_orderstatus < b.o_orderstatus GROUP BY 1, 2")
def u4(spark, sf):
    return D.overlap_counts(t(spark, sf, "orders"), "o_orderstatus", "o_custkey")


@query("u5_missing_pairs", "SELECT a.p_brand, b.p_size FROM (SELECT DISTINCT p_brand FROM part) a, (SELECT DISTINCT p_size FROM part) b EXCEPT SELECT p_brand, p_size FROM part")
def u5(spark, sf):
    return D.missing_pairs(t(spark, sf, "part"), "p_brand", "p_size")


@query("u6_distinct_rows", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), lang ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def u6(spark, sf):
    return D.distinct_rows(t(spark, sf, "documents"), [X.norm_key("text"), F.col("lang")], "doc_id").select("doc_id")


@query("u1_union", "SELECT role AS k, text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark")
def u1(spark, sf):
    c, b = t(spark, sf, "conversations"), t(spark, sf, "benchmark")
    return c.select(F.col("role").alias("k"), "text").unionByName(b.select("text", F.lit("benchmark").alias("k")))


@query("u3_route_union", "SELECT p_partkey, list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))) AS sources FROM (SELECT p_partkey, [p_brand, 'x'] AS a, CASE WHEN p_brand = 'x' THEN ['y'] ELSE ['x', 'y'] END AS b FROM part)")
def u3(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", F.array("p_brand", F.lit("x")).alias("a"), F.array(F.lit("x"), F.lit("y")).alias("b"))
    return C.route_many(p, ["a", "b"], ["p_partkey"]).select("p_partkey", "sources")


@query("a29_drop_reasons", "SELECT r AS reason, count(*) AS n FROM (SELECT CASE WHEN length(text) < 100 THEN 'short' WHEN lang = 'fr' THEN 'language' WHEN source = 'src0' THEN 'source' ELSE 'kept' END AS r FROM documents) GROUP BY 1")
def a29(spark, sf):
    r = E.first_drop_reason([("short", F.length("text") < 100), ("language", F.col("lang") == "fr"), ("source", F.col("source") == "src0")])
    return E.counts(t(spark, sf, "documents").withColumn("reason", r), "reason")


# evaluation --------------------------------------------------------------------------------------------------------------

_RUN = """WITH run AS (SELECT o_orderkey AS id, o_orderpriority AS lang, CASE o_orderkey % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'refute' ELSE 'neutral' END AS expected, CASE o_custkey % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'refute' ELSE 'neutral' END AS pre,
  CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'refute' ELSE 'neutral' END ELSE 'neutral' END AS post, (o_orderkey * 31 % 100)::DOUBLE / 100 AS conf, o_totalprice / 1000 AS sec, o_orderstatus = 'P' AS blocked, o_custkey % 4 < 3 AS triggered, o_custkey % 4 < 2 AS used FROM orders)
"""


def run(spark, sf):
    side = lambda c: F.when(c % 3 == 0, "support").when(c % 3 == 1, "refute").otherwise("neutral")
    o, k, c = t(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("id"), F.col("o_orderpriority").alias("lang"), side(k).alias("expected"), side(c).alias("pre"), F.when(c % 2 == 0, side(k)).otherwise("neutral").alias("post"), (k * 31 % 100 / F.lit(100.0)).alias("conf"), (F.col("o_totalprice") / 1000).alias("sec"), (F.col("o_orderstatus") == "P").alias("blocked"), (c % 4 < 3).alias("triggered"), (c % 4 < 2).alias("used"))


_ALL = "coalesce(lang, 'all') AS language"


@query("a16_accuracy_table", _RUN + f"SELECT {_ALL}, count(*) AS total, count(*) FILTER (WHERE pre = expected) AS pre_correct, count(*) FILTER (WHERE post = expected) AS post_correct, round(count(*) FILTER (WHERE pre = expected)::DOUBLE / count(*), 6) AS pre_accuracy, round(count(*) FILTER (WHERE post = expected)::DOUBLE / count(*), 6) AS post_accuracy FROM run GROUP BY ROLLUP (lang)")
def a16(spark, sf):
    a = E.accuracy_table(run(spark, sf), "lang", "expected", "pre", "post")
    return a.select(F.col("lang").alias("language"), "total", "pre_correct", "post_correct", F.round("pre_accuracy", 6).alias("pre_accuracy"), F.round("post_accuracy", 6).alias("post_accuracy"))


@query("a17_interventions", _RUN + f"SELECT {_ALL}, count(*) AS total, count(*) FILTER (WHERE triggered) AS llm_triggered, count(*) FILTER (WHERE used) AS llm_used, count(*) FILTER (WHERE pre <> post) AS verdict_changed, count(*) FILTER (WHERE pre <> post AND post = 'neutral') AS changed_to_neutral, count(*) FILTER (WHERE pre <> post AND pre = 'neutral') AS changed_from_neutral, count(*) FILTER (WHERE triggered AND NOT used) AS triggered_but_not_used FROM run GROUP BY ROLLUP (lang)")
def a17(spark, sf):
    return E.intervention_table(run(spark, sf), "lang", "pre", "post", "triggered", "used").withColumnRenamed("lang", "language")


@query("a18_transitions", _RUN + f"SELECT {_ALL}, expected, pre, post, count(*) AS n FROM run GROUP BY GROUPING SETS ((lang, expected, pre, post), (expected, pre, post))")
def a18(spark, sf):
    return E.transition_table(run(spark, sf), "lang", ["expected", "pre", "post"]).withColumnRenamed("lang", "language")


@query("a19_phase_confidence", _RUN + "SELECT lang, 'post' AS phase, round(avg(conf), 6) AS mean FROM run GROUP BY lang UNION ALL SELECT lang, 'pre', round(avg(sec), 6) FROM run GROUP BY lang")
def a19(spark, sf):
    return E.unpivot_mean(run(spark, sf), "lang", {"conf": "post", "sec": "pre"})


@query("a9_run_metrics", _RUN + """
SELECT count(*) AS total, count(*) FILTER (WHERE blocked) AS n_blocked, round(count(*) FILTER (WHERE NOT blocked AND expected = post)::DOUBLE / count(*) FILTER (WHERE NOT blocked), 6) AS accuracy, round(count(*) FILTER (WHERE expected = post)::DOUBLE / count(*), 6) AS raw_accuracy, round(count(*) FILTER (WHERE (NOT blocked AND expected = post) OR (blocked AND expected = 'neutral'))::DOUBLE / count(*), 6) AS blocked_adjusted,
  round(count(*) FILTER (WHERE post = 'neutral')::DOUBLE / count(*), 6) AS neutral_rate, round(avg(conf), 6) AS mean_confidence, round(median(sec), 6) AS median_seconds, count(*) FILTER (WHERE expected = 'support' AND post = 'support') AS tp, count(*) FILTER (WHERE expected = 'refute' AND post = 'refute') AS tn, count(*) FILTER (WHERE expected <> 'support' AND post = 'support') AS fp, count(*) FILTER (WHERE expected = 'support' AND post <> 'support') AS fn FROM run
""")
def a9(spark, sf):
    m = E.run_metrics(run(spark, sf), "expected", "post", "conf", "sec", "blocked").drop("mean_seconds")
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "raw_accuracy", "blocked_adjusted", "neutral_rate")})


_TP, _FP, _FN = ("count(*) FILTER (WHERE expected = 'support' AND pre = 'support')", "count(*) FILTER (WHERE expected <> 'support' AND pre = 'support')", "count(*) FILTER (WHERE expected = 'support' AND pre <> 'support')")


@query("a11_support_metrics", _RUN + f"SELECT lang, count(*) AS total, {_TP} AS tp, count(*) FILTER (WHERE expected <> 'support' AND pre <> 'support') AS tn, {_FP} AS fp, {_FN} AS fn, round(2.0 * {_TP} / (2 * {_TP} + {_FP} + {_FN}), 6) AS f1, round({_FP}::DOUBLE / count(*) FILTER (WHERE expected <> 'neutral'), 6) AS fpr, round(count(*) FILTER (WHERE expected = 'neutral' AND pre = 'neutral')::DOUBLE / count(*) FILTER (WHERE expected = 'neutral'), 6) AS neutral_recall FROM run GROUP BY lang")
def a11(spark, sf):
    m = E.support_metrics(run(spark, sf), ["lang"], "expected", "pre", digits=9)
    return m.select("lang", "total", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("f1", "fpr", "neutral_recall")])


@query("a13_confusion", _RUN + ", l AS (SELECT * FROM (VALUES ('support'), ('refute'), ('neutral'), ('none')) v(x)), c AS (SELECT lang, expected, pre, count(*) AS n FROM run GROUP BY ALL) SELECT g.lang, e.x AS expected, p.x AS pre, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang FROM run) g, l e, l p LEFT JOIN c ON c.lang = g.lang AND c.expected = e.x AND c.pre = p.x")
def a13(spark, sf):
    return E.confusion(run(spark, sf), "expected", "pre", ["support", "refute", "neutral", "none"], "lang")


_CLS = """, g AS (SELECT lang, l, count(*) FILTER (WHERE e = l)::DOUBLE AS s, count(*) FILTER (WHERE p = l)::DOUBLE AS c, count(*) FILTER (WHERE e = l AND p = l)::DOUBLE AS tp FROM (SELECT lang, expected AS e, pre AS p FROM run), (VALUES ('support'), ('refute'), ('neutral')) v(l) GROUP BY lang, l),
m AS (SELECT *, CASE WHEN c > 0 THEN tp / c ELSE 0 END AS pr, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS re, CASE WHEN s + c > 0 THEN 2 * tp / (s + c) ELSE 0 END AS f FROM g)
SELECT lang, sum(s)::BIGINT AS total, round(sum(tp) / sum(s), 6) AS accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * s) / sum(s), 6) AS weighted_f1, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall FROM m GROUP BY lang"""


@query("a21_class_metrics", _RUN + _CLS)
def a21(spark, sf):
    return E.class_metrics(run(spark, sf), "expected", "pre", ["lang"])


@query("a23_ranking", """
WITH x AS (SELECT (doc_id * 37 % 101)::DOUBLE / 100 AS s, quality AS y FROM labels), p AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY s),
q AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM p WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, round((sum(neg * (tp - pos * 0.5::DOUBLE)) / (sum(pos) * sum(neg)))::DOUBLE, 6) AS roc_auc, round((sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos))::DOUBLE, 6) AS average_precision FROM q
""")
def a23(spark, sf):
    r = t(spark, sf, "labels").select((F.col("doc_id") * 37 % 101 / F.lit(100.0)).alias("s"), F.col("quality").alias("y"))
    return E.ranking_metrics(r, "s", "y")


@query("a31_threshold_sweep", "SELECT th AS threshold, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM (SELECT th, count(*) FILTER (WHERE s >= th AND y = 1) AS tp, count(*) FILTER (WHERE s >= th AND y = 0) AS fp, count(*) FILTER (WHERE s < th AND y = 1) AS fn FROM (SELECT (doc_id * 37 % 101)::DOUBLE / 100 AS s, quality AS y FROM labels), (VALUES (0.05::DOUBLE), (0.25), (0.5), (0.75)) v(th) GROUP BY th)")
def a31(spark, sf):
    r = t(spark, sf, "labels").select((F.col("doc_id") * 37 % 101 / F.lit(100.0)).alias("s"), F.col("quality").alias("y"))
    return E.threshold_sweep(r, "s", "y", [0.05, 0.25, 0.5, 0.75])


@query("a15_stage_timings", "SELECT event_type AS stage, round(s, 6) AS seconds, round(CASE WHEN event_type <> 'view' THEN s / sum(CASE WHEN event_type <> 'view' THEN s END) OVER () END, 6) AS share, event_type = (SELECT event_type FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY sum(value::DECIMAL(30,12)) DESC, 1 DESC LIMIT 1) AS dominant FROM (SELECT event_type, sum(value::DECIMAL(30,12))::DOUBLE AS s FROM events GROUP BY 1)")
def a15(spark, sf):
    return E.stage_timings(t(spark, sf, "events").withColumnRenamed("event_type", "stage"), "stage", "value", "view")


@query("a20_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def a20(spark, sf):
    return E.counts(t(spark, sf, "documents"), "lang", "source")


@query("a24_summary_cube", "SELECT coalesce(l_returnflag, 'all') AS split, coalesce(l_linestatus, 'all') AS label, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a24(spark, sf):
    c = t(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return c.select(F.coalesce("l_returnflag", F.lit("all")).alias("split"), F.coalesce("l_linestatus", F.lit("all")).alias("label"), "n")


@query("a26_audit", _RUN + f"SELECT {_ALL}, count(*) AS total, count(*) FILTER (WHERE blocked) AS uncheckable, count(*) FILTER (WHERE NOT blocked) AS checkable FROM run GROUP BY ROLLUP (lang)")
def a26(spark, sf):
    a = E.rollup_all(run(spark, sf), "lang", [F.count("*").alias("total"), F.count_if("blocked").alias("uncheckable"), F.count_if(~F.col("blocked")).alias("checkable")])
    return a.withColumnRenamed("lang", "language")


@query("a27_document_summary", "SELECT o_custkey, o_orderstatus AS verdict, o_totalprice AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def a27(spark, sf):
    return K.top(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 1).select("o_custkey", F.col("o_orderstatus").alias("verdict"), F.col("o_totalprice").alias("confidence"))


# provider calls ----------------------------------------------------------------------------------------------------------


@query("st1_sliding_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def st1(spark, sf):
    return L.sliding_count(t(spark, sf, "events"), "user_id", seconds=3600).select("event_id", "in_window")


@query("st1_admission", """
WITH l AS (SELECT user_id, list({'k': event_id, 't': ts} ORDER BY ts, event_id) AS l FROM events GROUP BY user_id),
a AS (SELECT user_id, l, list_transform(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: x.t - y.t < INTERVAL 86400 SECONDS)) < 2 THEN list_append(a, x) ELSE a END, l[1:0]), lambda y: y.k) AS ok FROM l)
SELECT x.k AS key, user_id AS bucket, x.t AS ts, list_contains(ok, x.k) AS admitted FROM (SELECT user_id, ok, unnest(l) AS x FROM a)
""")
def st1b(spark, sf):
    return L.admit(t(spark, sf, "events"), "user_id", seconds=86400, limit=2)


@query("st4_cooldown", """
SELECT event_id, greatest(ts, coalesce(max(CASE WHEN event_id % 7 = 0 THEN ts END) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) + INTERVAL 3600 SECONDS, ts)) AS ready FROM events
""")
def st4(spark, sf):
    return L.cooldown(t(spark, sf, "events"), "event_type", F.col("event_id") % 7 == 0, seconds=3600).select("event_id", "ready")


@query("st5_usage", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st5(spark, sf):
    return L.usage(t(spark, sf, "events"), "event_type", every="1 hour")


# whole plans -------------------------------------------------------------------------------------------------------------


@query("plan_verify_claims", verify.SQL)
def plan_verify(spark, sf):
    return verify.verify_claims(t(spark, sf, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim")), t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text"), UP, DOWN, EVEN)


_WORDS = r"len(list_filter(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '), lambda w: w <> ''))"
_EDGES = r"^[\s\-–—•*]+|[\s\-–—•*]+$"
_CLEANED = rf"regexp_replace(regexp_replace(replace(regexp_replace(x, '{_EDGES}', '', 'g'), chr(2), ''), '{X.OCR_PREFIX}', ''), '^\s+|\s+$', '', 'g')"
_LIKE = rf"""(NOT regexp_matches(lower(@), '^(?:(?:figure|table|chart|source|note|page|section){X.RIGHT}|fig\.[\p{{L}}\p{{N}}_])') AND (regexp_matches(@, '[.!?।]$') OR len(list_intersect(regexp_extract_all(lower(@), '([A-Za-z'']+)'), [{", ".join(f"'{v}'" for v in X.SENTENCE_VERBS)}])) > 0 OR regexp_matches(@, '[,:;]')))"""
_FACTS = rf"(regexp_matches(x, '{X.LEFT}\d{{1,4}}{X.RIGHT}|%|₹|\$') OR regexp_matches(x, '{X.LEFT}[A-Z][a-z]+{X.RIGHT}') OR " + " OR ".join(f"contains(lower(x), '{v}')" for v in X.FACT_VERBS) + ")"
_OPINIONS = " OR ".join(f"contains(lower(x), '{o}')" for o in OPINION)


@query("plan_best_claims", rf"""
WITH a AS (SELECT doc_id, text, regexp_replace(trim(regexp_replace(regexp_replace(text, '\b([A-Za-z])\.\s+([A-Za-z])\.\b', '\1.\2.', 'g'), '\s+', ' ', 'g')), '\b((?:[A-Za-z]\.){{2,}})', '\1' || chr(2), 'g') AS m FROM documents),
c AS (SELECT doc_id, list_filter(list_transform({SENTENCES.replace("(text,", "(m,")}, lambda x: {_CLEANED}), lambda x: length(x) >= 20 AND {_WORDS.format('x')} BETWEEN 15 AND 80 AND {_LIKE.replace('@', 'x')}) AS l FROM a),
e AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS x FROM c UNION ALL SELECT doc_id, 1000000000 + i, l[i] || ' ' || l[i + 1] FROM (SELECT doc_id, l, unnest(range(1, len(l))) AS i FROM c WHERE len(l) > 1) WHERE {_WORDS.format("(l[i] || ' ' || l[i + 1])")} BETWEEN 15 AND 80),
f AS (SELECT doc_id, list({{'pos': pos, 'x': x, 'k': k, 'w': list_distinct(regexp_extract_all(k, '([A-Za-zऀ-ൿ0-9%]+)', 1))}} ORDER BY pos) AS l FROM (SELECT *, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS k FROM e WHERE {_FACTS}) GROUP BY doc_id),
g AS (SELECT doc_id, list_reduce(l, lambda k, x: CASE WHEN len(k) < 20 AND len(list_filter(k, lambda y: y.k = x.k OR len(list_intersect(x.w, y.w))::DOUBLE / greatest(len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)), 1) >= 0.78)) = 0 THEN list_append(k, x) ELSE k END, l[1:0]) AS k FROM f),
h AS (SELECT doc_id, y.pos AS pos, y.x AS x FROM (SELECT doc_id, unnest(k) AS y FROM g)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS n FROM (SELECT *, round(({_claim_score('x')})::DOUBLE, 6) AS score FROM h WHERE NOT ends_with(trim(x), '?') AND NOT ({_OPINIONS}))),
b AS (SELECT doc_id, x AS sentence, score FROM r WHERE n = 1),
z AS (SELECT doc_id, list_filter({PIECES.format('text', '.!?।')}, lambda x: {_WORDS.format('x')} >= 15 AND {_LIKE.replace('@', 'x')})[1] AS sentence FROM documents)
SELECT doc_id, coalesce(b.sentence, z.sentence) AS sentence, score FROM z LEFT JOIN b USING (doc_id) WHERE coalesce(b.sentence, z.sentence) IS NOT NULL
""")
def plan_documents(spark, sf):
    return verify.best_claims(t(spark, sf, "documents"), "doc_id", "text")
