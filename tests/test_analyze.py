from pyspark.sql import functions as F

from claimloom.plans.analyze import Settings, analyze


def test_from_rows_to_verdicts(spark):
    claims = [(1, "The river Ganga flooded five districts in Bihar", "en"), (2, "Is it raining?", "en"), (3, "The river Ganga flooded five districts in Bihar", "hi"), (4, "Nothing at all was ever retrieved for this", "en")]
    good = "Officials confirmed that the river Ganga flooded five districts in Bihar, verified and accurate. "
    bad = "The report that river Ganga flooded five districts in Bihar is false, debunked and fake. "
    rows = [(1, k, good + "x" * 60 + str(k), f"https://h{k}.example.gov/{k}", "web_search") for k in range(5)]
    rows += [(1, 5, good + "x" * 60 + "0", "https://h0.example.gov/0?again=1", "web_search")]
    rows += [(3, k, bad + "y" * 60 + str(k), f"https://h{k}.example.gov/{k}", "web_search") for k in range(5)]
    rows += [(2, 0, good, "https://a.org", "web_search"), (1, 9, " ", "https://empty.org", "web_search")]
    c = spark.createDataFrame(claims, "claim_id int, claim string, lang string")
    r = spark.createDataFrame(rows, "claim_id int, pos int, snippet string, link string, type string")
    got = {x.claim_id: x for x in analyze(c, r, Settings()).collect()}
    assert (got[1].verdict, got[1].evidence_count) == ("support", 5)
    assert got[1].reasoning.startswith("Analyzed 5 evidence sources.")
    assert (got[2].verdict, got[2].confidence) == ("neutral", 0.0) and got[2].reason == "too_short"
    assert (got[4].verdict, got[4].confidence, got[4].evidence_count) == ("neutral", 0.3, 0)
    assert got[3].verdict in ("refute", "neutral") and got[3].evidence_count == 5


def test_no_rows(spark):
    c = spark.createDataFrame([(1, "a claim of more than six words here", "en")], "claim_id int, claim string, lang string")
    r = spark.createDataFrame([], "claim_id int, pos int, text string, url string")
    assert analyze(c, r).select("verdict", F.col("confidence")).first() == ("neutral", 0.3)
