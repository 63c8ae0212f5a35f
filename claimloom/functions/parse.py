"""Reading what verifiers and rerankers answer: JSON, broken JSON, key-value text, plain words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clamp, col, stripped

# Names of verdicts and plain-text cues, later ones winning.
SUPPORT = ["support", "supported", "supported_by_evidence", "true", "verified", "verifies", "entails", "entailment", "likely_true"]
REFUTE = ["refute", "refuted", "refutes", "false", "misleading", "unsupported", "not_supported", "contradiction", "contradicted", "debunked", "likely_false"]
CUES = [
    (r"(?:support|supported|entailment|true|verified)", "support"),
    (r"(?:refute|refuted|contradiction|contradicted|false|misleading|debunked|unsupported)", "refute"),
    (r"(?:neutral|uncertain|not enough evidence|insufficient|inconclusive|unknown|mixed)", "neutral"),
    (r"(?:not\s+supported|does\s+not\s+support|not\s+true|incorrect)", "refute"),
    (r"(?:cannot\s+verify|can['’]t\s+verify)", "neutral"),
]
#: Cues anywhere in a text, also of other languages, where none of the words above is found; the first that is found decides.
LENIENT = {
    "support": [
        "correct", "yes", "supported by evidence", "claim is true", "सही", "सत्य", "உண்மை", "நிரூபிக்கப்பட்டது", "నిజం", "సరైనది", "ಸತ್ಯ", "ಸರಿಯಾಗಿದೆ", "സത്യം", "ശരി",
    ],
    "refute": [
        "incorrect", "wrong", "no", "claim is false", "गलत", "असत्य", "தவறு", "பொய்", "తప్పు", "అబద్ధం", "ತಪ್ಪು", "ಸುಳ್ಳು", "തെറ്റ്", "അസത്യ",
    ],
    "neutral": [
        "cannot verify", "not enough", "insufficient", "unclear", "unknown", "अनिश्चित", "पर्याप्त प्रमाण नहीं", "தெரியவில்லை", "போதுமான ஆதாரம் இல்லை", "సరిపడ ఆధారాలు లేవు",
        "ಅಪರ್ಯಾಪ್ತ ಸಾಕ್ಷಿ", "മതിയായ തെളിവില്ല",
    ],
}
# Patterns of keyed values, whose matches results depend on: a key's value, its confidence and reason, and those in plain text.
KEYED = r"(?i)[\"']?{}[\"']?\s*[:=]\s*[\"']?([a-zA-Z_ -]+)"
KEYED_CONFIDENCE = r"(?i)[\"']?confidence[\"']?\s*[:=]\s*[\"']?([0-9]{1,3}(?:\.[0-9]+)?%?)"
KEYED_REASON = r"(?is)[\"']?(?:reason|rationale|explanation)[\"']?\s*[:=]\s*[\"']?(.+)"
PLAIN_CONFIDENCE, PLAIN_PERCENT = r"confidence[^0-9]*([01](?:\.\d+)?)", r"([0-9]{1,3}(?:\.\d+)?)\s*%"
PLAIN_REASON = r"(?is)reason[^:]*:\s*(.+)"
KEYS = ["verdict", "label", "classification", "decision", "result"]
_B, _E = r"(?:^|[^a-z0-9_])", r"(?:$|[^a-z0-9_])"


def unfenced(c: Column | str) -> Column:
    """Without a ``` fence around it."""
    t = F.trim(F.coalesce(col(c), F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z0-9_-]*\s*", ""), r"\s*```$", "")
    return F.trim(F.when(F.startswith(t, F.lit("```")), inner).otherwise(t))


def verdict_name(c: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.isin(*SUPPORT), "support").when(v.isin(*REFUTE), "refute").otherwise("neutral")


def plain_verdict(c: Column) -> Column:
    """What the last matching cue says; without any, the kind whose first lenient cue occurs, in their order; else null."""
    low, out = F.lower(c), F.lit(None).cast("string")
    for name, cues in reversed(LENIENT.items()):
        out = F.when(low.rlike("|".join(cues)), name).otherwise(out)
    for pattern, name in CUES:
        out = F.when(low.rlike(_B + pattern + _E), name).otherwise(out)
    return out


def _number(raw: Column) -> Column:
    v = F.regexp_extract(raw, r"^([0-9.]+)", 1).try_cast("double")
    return clamp(F.when(F.endswith(raw, F.lit("%")) | ((v > 1) & (v <= 100)), v / 100).otherwise(v))


def verifier_answer(c: Column | str) -> Column:
    """struct(verdict, confidence, reason) of strict JSON, of the {...} in a text, of keyed values, or of plain words.

    verdict is null where nothing is recognised. confidence defaults to 0.5; that of plain words is a number after the
    word, or else the first percentage. reason is what follows its key, or the text's first 600 characters.
    """
    raw = unfenced(c)
    kind = "verdict string, label string, confidence string, reason string"
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    whole = F.coalesce(F.when(F.from_json(raw, kind)["verdict"].isNotNull(), F.from_json(raw, kind)), F.when(F.from_json(inner, kind)["verdict"].isNotNull(), F.from_json(inner, kind)))
    keyed = F.coalesce(*[F.when((x := F.regexp_extract(raw, KEYED.format(k), 1)) != "", verdict_name(x)) for k in KEYS])
    got = lambda text, pattern: F.when((x := F.regexp_extract(text, pattern, 1)) != "", x)
    low = F.lower(raw)
    plain = F.coalesce(got(low, PLAIN_CONFIDENCE).try_cast("double"), got(low, PLAIN_PERCENT).try_cast("double") / 100)
    confidence = F.coalesce(F.when(keyed.isNotNull(), _number(got(raw, KEYED_CONFIDENCE))).otherwise(plain), F.lit(0.5))
    why = F.when(keyed.isNotNull(), stripped_of_marks(got(raw, KEYED_REASON))).otherwise(stripped(got(raw, PLAIN_REASON)))
    return F.struct(
        F.when(whole.isNotNull(), verdict_name(whole["verdict"])).otherwise(F.coalesce(keyed, plain_verdict(raw))).alias("verdict"),
        F.when(whole.isNotNull(), F.coalesce(_number(whole["confidence"]), F.lit(0.5))).otherwise(confidence).alias("confidence"),
        F.when(whole.isNotNull(), F.coalesce(whole["reason"], F.lit(""))).otherwise(F.substring(F.coalesce(why, raw), 1, 600)).alias("reason"),
    )


def stripped_of_marks(c: Column) -> Column:
    """Without white space, then without quotes, commas, closing braces and blanks, at both ends."""
    return F.regexp_replace(stripped(c), r'^[",} ]+|[",} ]+\z', "")


def closed_json(c: Column | str) -> Column:
    """JSON cut off at its end, with an open string and open brackets closed."""
    t = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s*```$", ""))
    quotes = F.regexp_count(F.regexp_replace(t, r"\\.", ""), F.lit('"'))
    t = F.concat(t, F.when(quotes % 2 == 1, '"').otherwise(""))
    missing = lambda a, b: F.greatest(F.regexp_count(t, F.lit(a)) - F.regexp_count(t, F.lit(b)), F.lit(0))
    return F.when(t == '"', "").otherwise(F.concat(t, F.repeat(F.lit("]"), missing(r"\[", r"\]")), F.repeat(F.lit("}"), missing(r"\{", r"\}"))))


def line_updates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, idx, relevance, stance, confidence, reason of lines `EVIDENCE n | relevance=.. | stance=.. | conf=.. | reason=..`;
    the first line of each index counts, a missing confidence is 0.6."""
    lines = rows.select(key, F.posexplode(F.split(F.coalesce(content, F.lit("")), r"\r?\n")).alias("line", "t"))
    part = lambda p: F.regexp_extract("t", "(?i)" + p, 1)
    r = lines.where(F.col("t").rlike(r"(?i)EVIDENCE\s+\d+\s*\|.*relevance\s*=\s*[0-9]*\.?[0-9]+\s*\|.*stance\s*=\s*(?:support|refute|neutral)\s*\|.*reason\s*=\s*\S"))
    conf = part(r"conf(?:idence)?\s*=\s*([0-9]*\.?[0-9]+)\s*\|")
    r = r.select(key, "line", part(r"EVIDENCE\s+(\d+)").cast("int").alias("idx"), part(r"relevance\s*=\s*([0-9]*\.?[0-9]+)").cast("double").alias("relevance"), F.lower(part(r"stance\s*=\s*(support|refute|neutral)")).alias("stance"), F.coalesce(F.when(conf != "", conf.cast("double")), F.lit(0.6)).alias("confidence"), F.substring(F.trim(part(r"reason\s*=\s*(.+)$")), 1, 220).alias("reason"))
    return r.groupBy(key, "idx").agg(F.min_by(F.struct("relevance", "stance", "confidence", "reason"), "line").alias("u")).select(key, "idx", "u.*")


def loose_updates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, idx, relevance, stance of loose objects that name an index, a relevance and a stance in this order."""
    p = r"(?is)(?:index|idx)\W*?[:=]\s*(\d+).*?(?:relevance|score)\W*?[:=]\s*([0-9]*\.?[0-9]+).*?(?:stance|label)\W*?[:=]\s*['\"]?(support|refute|neutral)"
    got = [F.regexp_extract_all(content, F.lit(p), k) for k in (1, 2, 3)]
    z = rows.select(key, F.posexplode(F.arrays_zip(got[0].alias("i"), got[1].alias("r"), got[2].alias("s"))).alias("n", "u"))
    z = z.select(key, "n", F.col("u.i").cast("int").alias("idx"), F.col("u.r").cast("double").alias("relevance"), F.lower("u.s").alias("stance"))
    return z.groupBy(key, "idx").agg(F.min_by(F.struct("relevance", "stance"), "n").alias("u")).select(key, "idx", "u.*")


# How an update of a loose object is written: an index, a relevance and a stance in this order, and if they
# follow a confidence and a reason; names stand directly before their `:` or `=`.
PLAIN_UPDATE = r"""(?is)(?:index|idx)\s*[:=]\s*(\d+).*?(?:relevance|score)\s*[:=]\s*([0-9]*\.?[0-9]+).*?(?:stance|label)\s*[:=]\s*['"]?(support|refute|neutral)['"]?(?:.*?(?:confidence|conf)\s*[:=]\s*([0-9]*\.?[0-9]+))?(?:.*?(?:reason|why)\s*[:=]\s*['"]?([^,\n\r\}\]]{1,220}))?"""


def plain_updates(rows: DataFrame, key: str, content: str) -> DataFrame:
    """key, idx, relevance, stance, confidence, reason of loose objects whose names are not quoted (`PLAIN_UPDATE`), so that a
    truncated JSON list, whose keys are, gives none. A missing confidence is 0.6, a missing reason empty; the first object of
    each index counts. A confidence or reason that an object lacks is that of the next object, which then gives no update."""
    got = [F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(PLAIN_UPDATE), k).alias(f"g{k}") for k in range(1, 6)]
    z = rows.select(key, F.posexplode(F.arrays_zip(*got)).alias("n", "u"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    reason = F.regexp_replace(F.coalesce("u.g5", F.lit("")), r"^\s+|\s+$", "")
    z = z.select(key, "n", F.col("u.g1").cast("int").alias("idx"), F.col("u.g2").cast("double").alias("relevance"), F.lower("u.g3").alias("stance"), F.coalesce(filled("u.g4").cast("double"), F.lit(0.6)).alias("confidence"), reason.alias("reason"))
    return z.groupBy(key, "idx").agg(F.min_by(F.struct("relevance", "stance", "confidence", "reason"), "n").alias("u")).select(key, "idx", "u.*")


def fever_text(c: Column | str) -> Column:
    """The texts of a JSON list of evidence: its first element is a triplet, or a list of triplets; joined by spaces."""
    nested = F.from_json(col(c), "array<array<array<string>>>")
    flat = F.from_json(col(c), "array<array<string>>")
    of = lambda items: F.trim(F.array_join(F.filter(F.transform(items, lambda x: F.trim(F.coalesce(F.get(x, F.lit(2)), F.lit("")))), lambda x: x != ""), " "))
    first_nested = F.get(nested, F.lit(0))
    is_nested = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s", "").startswith("[[[")
    return F.coalesce(F.when(is_nested, of(first_nested)).otherwise(of(F.slice(flat, 1, 1))), F.lit(""))
