"""Values worked out by hand for single functions, and operators against plain versions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimloom.functions import parse as A
from claimloom.functions import text as X
from claimloom.operators import dataset as D
from claimloom.operators import evaluate as E
from claimloom.operators import scoring as S
from claimloom.operators import verdict as V
from claimloom.plans import verify as P
from claimloom.sources import providers as W
from claimloom.sources import readers as R
from claimloom.streaming import limits as L


def values(spark, f, texts):
    d = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    return [r.v for r in d.select("k", f("t").alias("v")).orderBy("k").collect()]


def test_numbers_end_at_a_word(spark):
    got = values(spark, X.numeric_claim, ["grew 50% in", "50%x", "1,234, and", "3.5 million people", "12km", "12 KM off", "v2 of", "none", None, "5 crores", "7 years", "a٣ ٣٤"])
    assert got == ["50", "50%", "1,234", "3.5 million", "12km", "12 KM", "", "", "", "5", "7 years", "٣٤"]


def test_questions(spark):
    got = values(spark, X.to_question, ["The sky is blue.", "It is true;", "Is it?", "Is it? ", "Odd: thing!:;.  ", "...", "  ", "Two  blanks kept.", None])
    assert got == ["Is it true that The sky is blue?", "Is it true that It is true?", "Is it?", "Is it true that Is it??", "Is it true that Odd: thing?", "...", "  ", "Is it true that Two  blanks kept?", ""]


def test_keywords(spark):
    got = values(spark, X.keywords, ["The Moon ought to need a used Rocket", "I saw 42 (big) Cats, É x", "", "just because", "between each Two " + "w1 " * 12])
    assert got == ["Moon Rocket", "saw 42 Cats,", "", "", "Two" + " w1" * 9]


def test_anchors(spark):
    assert values(spark, lambda c: F.array_join(X.ascii_anchors(c), "|"), ["यह NASA और nasa 50% a 3.5kg x-ray 7 www.a.in/b", "कोई नहीं"]) == ["NASA|50%|3.5kg|x-ray|www.a.in/b", ""]


def test_clean_claims(spark):
    assert values(spark, X.clean_claim, ["a ​ b", " x  y\n", "﻿z‍", "“q”"]) == ["a  b", "x y", "z", "“q”"]


@pytest.mark.parametrize(
    "raw, verdict, confidence, reason",
    [
        ("सही", "support", 0.5, "सही"),
        ("गलत है, 90%", "refute", 0.9, "गलत है, 90%"),
        ("உண்மை", "support", 0.5, "உண்மை"),
        ("తప్పు", "refute", 0.5, "తప్పు"),
        ("ಅಪರ್ಯಾಪ್ತ ಸಾಕ್ಷಿ", "neutral", 0.5, "ಅಪರ್ಯಾಪ್ತ ಸಾಕ್ಷಿ"),
        ("സത്യം", "support", 0.5, "സത്യം"),
        ("It is correctly said", "support", 0.5, "It is correctly said"),
        ("Result shown: not supported by it. confidence: 0.73", "refute", 0.73, "Result shown: not supported by it. confidence: 0.73"),
        ("We cannot verify this; reason why: too few\n", "neutral", 0.5, "too few"),
        ('classification = "contradicted", confidence=76, explanation="sources disagree"', "refute", 0.76, "sources disagree"),
        ('{"verdict": "refute", "confidence": 87%, "reason": "false because "A" says so"\n}', "refute", 0.87, 'false because "A" says so"\n'),
        ('so: {"verdict":"Entailment","confidence":0.91,"reason":"r"} end', "support", 0.91, "r"),
        ("nichts", None, 0.5, "nichts"),
        ("", None, 0.5, ""),
    ],
)
def test_verifier_answers(spark, raw, verdict, confidence, reason):
    got = values(spark, A.verifier_answer, [raw])[0]
    assert (got.verdict, got.confidence, got.reason) == (verdict, pytest.approx(confidence), reason)


def test_structured_quality(spark):
    rows = [(0, "Mars has ice", "Mars shows ice caps. In 2004 Opportunity drilled 3 km of Mars rock there. Nothing else."), (1, "", "one two"), (2, "x", "  "), (3, "alpha beta gamma", "alpha said so 12 March 2020")]
    got = {r.k: r for r in S.enriched(spark.createDataFrame(rows, "k int, claim string, text string")).collect()}
    assert got[0].fact_span == "Mars shows ice caps. In 2004 Opportunity drilled 3 km of Mars rock there." and got[0].text == got[0].fact_span
    assert (got[0].entity, got[0].date, got[0].numeric_claim) == ("Mars", "2004", "2004")
    assert got[0].scrape_struct_quality == pytest.approx(0.55 * 2 / 3 + 0.45) and got[0].structured_from_scrape
    assert got[2].fact_span is None and got[2].scrape_struct_quality is None
    assert got[3].text == "alpha said so 12 March 2020" and got[3].scrape_struct_quality == pytest.approx(0.55 / 3 + 0.2 + 0.15 + 0.1)


def test_sentences_of_documents(spark):
    t = "The U.S. army left in 1990. Rate was 3.5 percent; then rose. पहला वाक्य॥ दूसरा。 third | fourth • fifth ‣ six"
    assert values(spark, X.claim_sentences, [t]) == [["The U.S. army left in 1990.", "Rate was 3.5 percent;", "then rose.", "पहला वाक्य।", "दूसरा।", "third .", "fourth .", "fifth .", "six"]]
    assert values(spark, X.claim_sentences, ["- OCR: Some text. AI) More. U. S. A"]) == [["Some text.", "More.", "U.", "S.", "A"]]
    assert values(spark, X.claim_sentences, ["In the U. S.A they said. So"]) == [["In the U.S.A they said.", "So"]]
    like = ["Figure 3: the map.", "It is here", "Source of it all.", "Sourced well, it", "no shape at all", "Fig. a", "Pages were lost", "  "]
    assert values(spark, X.sentence_like, like) == [False, True, False, True, False, False, True, False]
    assert values(spark, X.verifiable, ["no anchors only xyz", "costs ₹ much", "Paris fell", "12345 bc", "123 bc", "they recorded"]) == [False, True, True, False, True, True]


def test_best_claims(spark):
    long = "The committee of the city reported that 340 houses were affected by flooding of the river in 2019 and after."
    other = "It also states that nothing of the kind had happened there before the dam was built by them."
    soft = "we walk along small green paths near old mills while birds sing, and water runs all day."
    rows = [(1, f"Figure 2: {long} {long} {other}"), (2, "Short. Too short."), (3, soft.replace(", and", " and") + " Nothing"), (4, None)]
    got = {r.d: (r.sentence, r.score) for r in P.best_claims(spark.createDataFrame(rows, "d int, t string"), "d", "t").collect()}
    assert got[1][0].startswith(long) and got[1][1] > 4 and set(got) <= {1, 3}


def test_reasons_grow_with_the_stages(spark):
    rows = [(1, i, "support", None if i else "strong", 0.9, 0.8, 0.9, "type", "https://a.org") for i in range(3)]
    e = spark.createDataFrame(rows, "claim_id int, pos int, stance string, evidence_tier string, evidence_weight double, relevance double, credibility double, type string, url string")
    e = e.withColumn("weighted", F.struct(*[(F.col("evidence_weight") * x).alias(k) for k, x in (("support", 0.8), ("refute", 0.1), ("neutral", 0.1))]))
    d = V.decisive(e, "claim_id")
    assert d.first().support_score == pytest.approx(0.9 + 2 * 0.6 * 0.9) and d.first().strong_count == 1
    v = V.verdict(V.sums(e, "claim_id")).withColumn("reasoning", V.reasoning())
    base = v.first().reasoning
    v = V.calibrate(V.apply_gate(V.apply_decisive(v, d, "claim_id"), V.gate(e, "claim_id"), "claim_id"), F.lit(False))
    assert v.first().reasoning == f"{base} {V.DECISIVE} {V.GATED}" and v.first().verdict == "neutral"


def test_relevant_equals_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 20, 60])]) for _ in range(n))
    claims = [(i, text(rng.randint(1, 9))) for i in range(25)] + [(99, "the of"), (98, None)]
    docs = [(i, text(rng.randint(0, 30))) for i in range(400)]
    for part in (1, 8, 10**6):
        got = {}
        for r in P.relevant(spark.createDataFrame(claims, "claim_id int, claim string"), spark.createDataFrame(docs, "pos int, text string"), 10, part).collect():
            got.setdefault(r.claim_id, []).append((-r.relevance, r.pos))
        for c, claim in claims:
            w = set((claim or "").split()) - set(X.STOPWORDS)
            want = sorted((-min(1.0, len(w & set(t.split())) / len(w) * 1.5), pos) for pos, t in docs if w & set(t.split()))[:10] if w else []
            assert sorted(got.get(c, [])) == [(pytest.approx(s), p) for s, p in want]


def test_numbered_and_ranking_on_hot_groups(spark):
    d = spark.range(5000).select("id", F.when(F.col("id") < 4500, "hot").when(F.col("id") < 4990, "warm").alias("g"), ((F.col("id") * 7919 % 1000) / 1000).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = {r.id: r for r in D.numbered(d, ["g"], ["id"], "z").collect()}
    import hashlib

    for g in ("hot", "warm", None):
        ids = sorted((i for i, r in got.items() if r.g == g), key=lambda i: (hashlib.md5(f"z:{i}".encode()).hexdigest(), i))
        assert [got[i]["_k"] for i in ids] == list(range(1, len(ids) + 1)) and {got[i]["_n"] for i in ids} == {len(ids)}
    pairs = D.mismatched(d, ["g"], "id", "s", "z").collect()
    assert len(pairs) == 5000 and sorted(r.other_key for r in pairs) == list(range(5000)) and all(r.id != r.other_key for r in pairs)
    rows = d.collect()
    pos, neg = [r.s for r in rows if r.y], [r.s for r in rows if not r.y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg[::7]) / (len(pos) * len(neg[::7]))
    m = E.ranking_metrics(d, "s", "y").first()
    assert m.n_pos == len(pos) and m.n_neg == len(neg) and m.roc_auc == pytest.approx(auc, abs=0.01)
    plan = D.split(d, ["g"], ["id"], "z")._jdf.queryExecution().optimizedPlan().toString()
    assert all("sum(_c#" in line or "_b#" in line for line in plan.splitlines() if "windowspecdefinition(g#" in line)


def test_missing_pairs(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 3), ("c", None)], "x string, y int")
    assert sorted(map(tuple, D.missing_pairs(d, "x", "y").collect())) == [("a", 3), ("b", 2), ("b", 3), ("c", 1), ("c", 2), ("c", 3)]


def test_cooldown(spark):
    rows = [(i, t, limited) for i, (t, limited) in enumerate([(0, False), (1, True), (2, False), (3, True), (5, False), (7, False), (7, True)])]
    d = spark.createDataFrame(rows, "event_id int, t long, limited boolean").withColumn("ts", F.timestamp_seconds("t")).withColumn("b", F.lit("k"))
    got = [int(r.ready.timestamp()) for r in L.cooldown(d, "b", F.col("limited"), seconds=3).orderBy("event_id").collect()]
    assert got == [0, 1, 4, 4, 6, 7, 7]


def test_provider_rows(spark):
    d = spark.createDataFrame([(1, "b1", None, "https://x", None), (2, None, "T", None, "https://y")], "k int, body string, title string, href string, link string")
    got = [tuple(r[c] for c in ("k", "text", "title", "source", "url", "score", "type")) for r in W.web_rows(d, "duckduckgo").orderBy("k").collect()]
    assert got == [(1, "b1", "DuckDuckGo", "DuckDuckGo", "https://x", 0.4, "web_search"), (2, "", "T", "T", "https://y", 0.4, "web_search")]
    t = spark.createDataFrame([("c", 0.7), ("d", None)], "content string, score double")
    assert [r.score for r in W.web_rows(t, "tavily").collect()] == [0.7, 0.5]
    w = W.structured_rows(spark.createDataFrame([("A <b>x</b>", "Moon", 7)], "snippet string, title string, pageid int"), "Nope").first()
    assert (w.text, w.source, w.url, w.score) == ("A x", "Wikipedia: Moon", "https://en.wikipedia.org/?curid=7", 0.75)
    assert {s: W.structured_rows(spark.createDataFrame([("t",)], "title string"), s).first().score for s in (*W.STRUCTURED, "isro", "gov_api")} == W.STRUCTURED | {"isro": 0.92, "gov_api": 0.95}
    assert values(spark, lambda c: F.length(W.search_query(c, "tavily")), ["word " * 200]) == [399]


def test_model_slots(spark):
    assert R.class_order({0: "contradiction", 1: "entailment", 2: "neutral"}) == ["refute", "support", "neutral"]
    assert R.class_order({"0": "LABEL_0", "1": "true"}) == R.class_order(None) == ["support", "neutral", "refute"]
    s = R.stance_of([[0.0, 10.0, 0.0]], {0: "contradiction", 1: "entailment", 2: "nei"})
    assert s.support[0] > 0.99 and s.sum(axis=1)[0] == pytest.approx(1)
    assert R.relevance_of([[0.0, 0.0], [-9.0, 9.0]]).round(3).tolist() == [0.5, 1.0] and R.relevance_of([0.0]).tolist() == [0.5]
    claims = spark.createDataFrame([(1, "c"), (2, "d")], "claim_id int, claim string")
    rows = spark.createDataFrame([(1, 1, "s", 0.5, "first"), (1, 0, "s", 0.9, "zero")], "claim_id int, pos int, source string, relevance double, text string")

    def load():
        return lambda c, e: c + "|" + e.str.count("\n").astype(str) + "|" + e.str[:3]

    got = {r.claim_id: r.answer for r in R.verified(claims, rows, "claim_id", "pos", load).collect()}
    assert got == {1: "c|1|[1]", 2: "d|0|"} and R.verified(claims, rows, "claim_id", "pos").where("answer IS NOT NULL").count() == 0
    api = R.slot(lambda c: c.where(c.str.startswith("a"), ""), "string")
    local = R.slot(lambda c: pd.Series(c.str.upper()), "string")
    d = spark.createDataFrame([("ab",), ("cd",), ("cd",), (None,), ("",)], "t string")
    assert sorted((r.t or "", r.result or "") for r in R.chained(d, "t", ["t"], api, local).collect()) == [("", ""), ("", ""), ("ab", "ab"), ("cd", "CD"), ("cd", "CD")]
