"""Hand-made rows for the rules that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from claimloom.functions import parse as A
from claimloom.functions import text as X
from claimloom.functions import urls as U
from claimloom.operators import classify as C
from claimloom.operators import dataset as D
from claimloom.operators import evaluate as E
from claimloom.operators import evidence as N
from claimloom.operators import scoring as S
from claimloom.operators import selection as K
from claimloom.operators import verdict as V


def one(spark, expr, **values):
    cols = ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], cols).select(expr.alias("r")).first().r


def test_first_substring_decides_credibility(spark):
    assert one(spark, S.credibility(), source="p", url="https://pinterest.com/x", type="web_search") == 0.9  # contains "int"
    assert one(spark, S.credibility(), source="x", url="https://zzz.dev", type="web_search") == 0.7
    assert one(spark, S.credibility(), source="x", url="https://zzz.dev", type="scraping") == 0.5
    assert one(spark, S.credibility(), source="x", url="u", type="structured_api") == 0.9


def test_no_context_means_no_decay(spark):
    w = lambda ctx, date="2020-01-01", rel=0.5: one(spark, S.temporal_weight(F.col("d"), F.col("r"), F.col("c"), "2022-01-01"), d=date, r=rel, c=ctx)
    assert w("GENERAL_FACTUAL") == 1.0 and w(None) == 1.0 and w("HEALTH", "") == 1.0
    assert w("HEALTH", "soon") == 0.8
    assert w("HEALTH") == 0.4
    assert w("SCIENCE", rel=0.96) == pytest.approx(0.5 ** (731 / 30.44 / 36) + 0.35)


def test_all_zero_stance_is_support(spark):
    r = spark.createDataFrame([("a b", "c d")], "claim string, text string").select(S.keyword_stance("claim", "text").alias("p")).select("p.*", S.stance_label(F.col("p")).alias("l")).first()
    assert (r.support, r.refute, r.neutral, r.l) == (0.0, 0.0, 0.0, "support")


def verdict(spark, rows):
    e = spark.createDataFrame([(1, *r) for r in rows], "claim_id int, s double, r double, n double, evidence_weight double")
    e = e.withColumn("weighted", F.struct(F.col("s").alias("support"), F.col("r").alias("refute"), F.col("n").alias("neutral")))
    return V.verdict(V.sums(e, "claim_id")).first()


def test_verdict_edges(spark):
    v = verdict(spark, [(0.4, 0.4, 0.2, 1.0)])
    assert v.verdict == "neutral" and not v.conflict and v.confidence == pytest.approx(0.2 * 0.75)
    v = verdict(spark, [(0.45, 0.45, 0.1, 1.0)])
    assert v.conflict and v.confidence == pytest.approx(0.5 * 0.75)
    for n, m in ((1, 0.75), (2, 0.85), (3, 0.85), (4, 1.0)):
        assert verdict(spark, [(0.6, 0.1, 0.3, 1.0)] * n).confidence == pytest.approx(0.6 * m)
    # weighted stances are not weighted again
    assert verdict(spark, [(0.3, 0.1, 0.1, 0.5)] * 4).agg_support == pytest.approx(0.6)


def test_missing_evidence_and_uncheckable(spark):
    claims = spark.createDataFrame([(1, True), (2, False)], "claim_id int, ok boolean")
    none = spark.createDataFrame([], "claim_id int, verdict string, confidence double, evidence_count long")
    got = {r.claim_id: (r.verdict, r.confidence) for r in V.with_missing(claims, none, "claim_id", F.col("ok")).collect()}
    assert got == {1: ("neutral", 0.3), 2: ("neutral", 0.0)}


def test_gates_apply_in_order(spark):
    v = spark.createDataFrame([(1, "support", 0.9, 0.7, 0.2, 0.1)], "claim_id int, verdict string, confidence double, agg_support double, agg_refute double, agg_neutral double")
    d = spark.createDataFrame([(1, 2.0, 0.5, 1)], "claim_id int, support_score double, refute_score double, strong_count int")
    g = spark.createDataFrame([(1, 2)], "claim_id int, failed int")
    out = V.calibrate(V.apply_gate(V.apply_decisive(v, d, "claim_id"), g, "claim_id"), F.lit(False)).first()
    assert (out.verdict, out.confidence) == ("neutral", 0.65)


def test_reasons_round_half_even(spark):
    assert one(spark, V.percent(F.col("x")), x=0.125) == "12%"


def test_reasons(spark):
    rows = [(0.6, 0.1, 0.3, 4, False, "support", 0.6), (0.45, 0.45, 0.1, 1, True, "neutral", 0.375)]
    d = spark.createDataFrame(rows, "agg_support double, agg_refute double, agg_neutral double, evidence_count long, conflict boolean, verdict string, confidence double")
    assert [r[0] for r in d.select(V.reasoning()).collect()] == [
        "Analyzed 4 evidence sources. Support: 60%, Refute: 10%, Neutral: 30%. Moderate evidence supports this claim. Moderate confidence (60%).",
        "Analyzed 1 evidence sources. Conflicting evidence detected from different sources. Support: 45%, Refute: 45%, Neutral: 10%. Evidence is contradictory, no clear conclusion. Low confidence (38%). Further verification recommended.",
    ]


def test_urls(spark):
    for url, host in (("https://A.Example.com:8080/x", "a.example.com"), ("example.com/x", ""), (None, ""), ("http://.a.b./", "a.b")):
        assert one(spark, U.host("u"), u=url) == host
    assert one(spark, U.canonical_url("u"), u="HTTP://X.y/A/?q=1#f") == "http://x.y/a"
    p = U.Policy(bad_domains=("bad.org",))
    for url, ok in (("https://bad.org/a", False), ("https://x.bad.org/a", False), ("https://notbad.org/a", True), ("https://a.org/api/x", False), ("ftp://a.org", False), ("https://a.org/x.csv", False), ("https://a.org/xxx/y", False), ("https://a.org/wp-content/y", False)):
        assert one(spark, U.scrapable("u", p), u=url) is ok, url
    assert one(spark, U.blocked("u", p), u="") is False


def test_dates_and_numbers(spark):
    for raw, iso in (("2022-12-11", "2022-12-11T00:00:00"), ("Dec 11, 2022", "2022-12-11T00:00:00"), ("11 December 2022", "2022-12-11T00:00:00"), ("2022-12-11T10:00:00+05:30", "2022-12-11T10:00:00+05:30"), ("soon", ""), (None, "")):
        assert one(spark, X.published_at("d"), d=raw) == iso
    assert one(spark, X.first_date("t"), t="in 1999 or on 3 May 2001") == "3 May 2001"
    assert one(spark, X.numeric_claim("t"), t="about 3,500.5 million people") == "3,500.5 million"
    assert one(spark, X.ocr_clean("t"), t="pi is 3.14 , ok") == "pi is 3. 14, ok"


def test_scripts(spark):
    assert one(spark, X.detect_language("t", F.lit("auto")), t="यह एक दावा है") == "hi"
    assert one(spark, X.detect_language("t", F.lit("ta")), t="plain") == "ta"
    assert one(spark, X.language_ok("t", F.lit("hi")), t="यह एक लंबा हिंदी वाक्य है abc") is True
    assert one(spark, X.language_ok("t", F.lit("hi")), t="abc def ghi यह") is False
    assert one(spark, X.english_like("t"), t="123") is True
    assert one(spark, X.repaired("t"), t="यह".encode().decode("latin-1")) == "यह" and one(spark, X.repaired("t"), t="cafÃ©") == "cafÃ©"


def test_key_lengths_differ(spark):
    rows = spark.createDataFrame([(1, i, "", "w " * 80 + f"{'x' * k}") for i, k in enumerate((1, 2))] + [(1, 9, "", " ")], "c int, pos int, url string, text string")
    assert K.first_per_key(rows, ["c"], K.evidence_key(120), ["pos"]).count() == 1
    assert K.first_per_key(rows, ["c"], K.evidence_key(240), ["pos"]).count() == 2
    assert K.first_per_key(rows, ["c"], K.evidence_key(120), ["pos"], keep_empty=True).count() == 2


def test_relevance_floor_cases(spark):
    rows = [(1, i, f"https://h/{i}", "t", r) for i, r in enumerate((0.31, 0.30, 0.2, 0.1))] + [(2, 0, "https://h/0", "t", 0.1), (2, 1, "https://h/1", "t", 0.05)]
    d = spark.createDataFrame(rows, "claim_id int, pos int, url string, text string, relevance double")
    got = sorted((r.claim_id, r.pos) for r in K.relevance_floor(d, ["claim_id"], [F.desc("relevance"), "pos"]).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]


def test_split_sizes(spark):
    for n, test, val in ((1, 0, 0), (2, 1, 0), (3, 1, 1), (15, 2, 2), (25, 2, 2)):
        d = spark.range(n).withColumn("g", F.lit(0))
        c = {r.split: r["count"] for r in D.split(d, ["g"], ["id"], "s").groupBy("split").count().collect()}
        assert (c.get("test", 0), c.get("val", 0), c.get("train", 0)) == (test, val, n - test - val)


def test_two_true_negative_rules(spark):
    d = spark.createDataFrame([("refute", "neutral"), ("refute", "refute"), ("neutral", "refute")], "e string, p string")
    strict = d.agg(*E.binary_counts(F.col("e"), F.col("p"))).first()
    loose = d.agg(*E.binary_counts(F.col("e"), F.col("p"), negative=None)).first()
    assert (strict.tn, loose.tn) == (1, 3)


def test_metrics_against_plain_python(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.randint(0, 20) / 20, rng.randint(0, 1)) for _ in range(300)]
    m = E.ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    assert m.roc_auc == pytest.approx(auc, abs=1e-6)


def test_labels_and_order_of_topics(spark):
    assert one(spark, D.canonical_label(F.col("x")), x=" SUPPORTS ") == "support"
    assert one(spark, D.canonical_label(F.col("x")), x="what") is None
    dim = spark.createDataFrame([(1, "A", "x"), (2, "B", "y")], "pos int, label string, keyword string")
    c = spark.createDataFrame([(1, "x and y"), (2, "none"), (3, None)], "k int, t string")
    got = {r.k: (r.label, r.conf) for r in C.topics(c, dim, "k", "t", 3, 0.85, "D", 0.5).collect()}
    assert got == {1: ("A", pytest.approx(1 / 3)), 2: ("D", 0.5), 3: ("D", 0.5)}


def test_page_dates(spark):
    for html, iso in (
        ('<meta property="article:published_time" content="2021-05-06T07:08:09Z">', "2021-05-06T07:08:09"),
        ('<time datetime="2020-01-02">', "2020-01-02T00:00:00"),
        ('<script>{"datePublished": "2019-02-03"}</script>', "2019-02-03T00:00:00"),
        ("<p>on December 11, 2022 it was</p>", "2022-12-11T00:00:00"),
        ("<p>none</p>", ""),
    ):
        assert one(spark, N.publication_date("h"), h=html) == iso


@pytest.mark.parametrize(
    "raw, verdict, confidence",
    [
        ('```json\n{"verdict": "supported", "confidence": 0.9, "reason": "r"}\n```', "support", 0.9),
        ('Sure: {"verdict": "false", "confidence": 80} done', "refute", 0.8),
        ('{"verdict": "support", "confidence": 87%, "reason": "a "quoted" word"', "support", 0.87),
        ("The claim is not supported by evidence.", "refute", 0.5),
        ("label = neutral\nconfidence = 0.4", "neutral", 0.4),
        ("It is true, 75 % sure", "support", 0.75),
        ("nothing here", "refute", 0.5),  # the cue `no`, which is looked for anywhere
        ("hmm", None, 0.5),
    ],
)
def test_verifier_answers(spark, raw, verdict, confidence):
    r = spark.createDataFrame([(raw,)], "t string").select(A.verifier_answer("t").alias("r")).select("r.*").first()
    assert (r.verdict, r.confidence) == (verdict, pytest.approx(confidence))


def test_updates(spark):
    text = "EVIDENCE 1 | relevance=0.82 | stance=support | conf=0.77 | reason=says so\nEVIDENCE 1 | relevance=0.1 | stance=refute | reason=again\nEVIDENCE 3 | relevance=.5 | stance=Neutral | reason=none\nnoise"
    d = spark.createDataFrame([(7, text)], "k int, t string")
    assert sorted(map(tuple, A.line_updates(d, "k", "t").collect())) == [(7, 1, 0.82, "support", 0.77, "says so"), (7, 3, 0.5, "neutral", 0.6, "none")]
    d = spark.createDataFrame([(7, '[{"index": 2, "relevance": 0.4, "stance": "refute"}, {"index": 5, "score": 1, "label": "support"')], "k int, t string")
    assert sorted(map(tuple, A.loose_updates(d, "k", "t").collect())) == [(7, 2, 0.4, "refute"), (7, 5, 1.0, "support")]
    assert one(spark, F.get_json_object(A.closed_json("t"), "$.a[1]"), t='{"a": ["b", "x y') == "x y"


def test_fever_shapes(spark):
    assert one(spark, A.fever_text("t"), t='[["P", "1", "one"], ["Q", "2", "two"]]') == "one"
    assert one(spark, A.fever_text("t"), t='[[["P", "1", "one"], ["Q", "2", " two "]], [["R", "3", "x"]]]') == "one two"
    assert one(spark, A.fever_text("t"), t="[]") == "" and one(spark, A.fever_text("t"), t=None) == ""


def test_image_claims(spark):
    tail = "The statement that follows is certainly long enough!!"
    assert one(spark, C.image_claim("t"), t="Is it so? " + tail) == tail[:-1]
    assert one(spark, C.image_claim("t"), t="So? short") == "So? short"
    assert one(spark, C.several_claims("t"), t="One claim with five words here. Another claim with five words too") is True
    assert one(spark, X.without_artefact("t"), t="A claim. This claim is provided in Hindi.") == "A claim."


def test_quotas(spark):
    d = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(10)], "id int, label string")
    got = {r.label: r["count"] for r in D.to_quotas(d, "label", ["id"], {"a": 7, "b": 2}, "s").groupBy("label").count().collect()}
    assert got == {"a": 7, "b": 2}
    assert D.target_counts(10, {"a": 0.25, "b": 0.25, "c": 0.5}) == {"a": 2, "b": 2, "c": 6}




def test_plain_updates(spark):
    """Names stand before : or =; confidence and reason follow, or are the next object's, which then gives nothing."""
    texts = [
        "idx: 2, relevance = .4, Stance: 'Refute', conf=0.9, reason: it says so, and more", '[{"index": 2, "relevance": 0.4, "stance": "refute"}', None,
        "index=1 score=1 label=support\nindex=3 score=0.5 label=neutral confidence: 0.7 why: b", "index=1 score=1 label=support conf=1 why: a\nindex=1 score=0 label=refute conf=0 why: b",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = sorted(map(tuple, A.plain_updates(d, "k", "t").collect()))
    assert got == [(0, 2, 0.4, "refute", 0.9, "it says so"), (3, 1, 1.0, "support", 0.7, "b"), (4, 1, 1.0, "support", 1.0, "a")]


def test_updates_need_an_order(spark):
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "c int, i int, s string")
    u = spark.createDataFrame([(1, 1, "y", 2), (1, 1, "x", 1), (1, 9, "z", 0), (1, 2, None, 0)], "c int, i int, v string, _n int")
    assert sorted(r.s for r in V.apply_updates(e, u, "c", "i", "s", "v").collect()) == ["b", "x"]
    with pytest.raises(Exception, match="need their order"):
        V.apply_updates(e, u.drop("_n"), "c", "i", "s", "v").collect()


def test_branches_of_stance(spark):
    d = spark.createDataFrame([("hi", "en", 1, 2), ("EN", "en", 1, 2), ("hi", "multi", 1, 2), ("hi", None, 1, 2), (None, "en", 1, 2), ("hi", "en", 1, None)], "lang string, branch string, a int, b int")
    of = lambda **k: [r[0] for r in d.select(S.branch_stance(F.col("lang"), F.col("branch"), F.col("a"), F.col("b"), **k)).collect()]
    assert of() == [2, 1, 1, 1, 1, 1] and of(mixed=False) == [1] * 6


def test_queries_of_letters_without_a_capital(spark, tmp_path):
    import duckdb

    from claimloom import queries as Q

    texts = ["Erßie entech", "ŉa bc", "ß ss", "Straße strasse", "one ONE"]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.item_id, r.n, r.first) for r in Q.f21(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert got == set(c.execute(Q.SQL["f21_queries"]).fetchall())


def test_span_looks_at_no_more_than_it_takes(spark):
    """The span as plain code has it; one filter, of blank sentences, comes before the fold."""
    d = spark.createDataFrame([(" ".join(f"Word{'abc'[k % 3]} number {k if k % 2 else 'none'} here." for k in range(n)),) for n in (0, 1, 3, 90)], "t string")
    out = d.select(X.fact_span("t", F.array(F.lit("worda"))).alias("s"), "t")
    assert "filter(filter(" not in out._jdf.queryExecution().analyzed().toString()
    for r in out.collect():
        every, run = [x for x in r.t.split(". ") if x], ""
        every = [x if x.endswith(".") else x + "." for x in every]
        for x in every:
            if len(run) <= 700 and ("Worda" in x or "none" not in x):
                run = f"{run} {x}".strip()
        assert r.s == (run or "".join(every[:1]))[:900]
