"""Many keywords in one pass, against one search for each."""

import random

from pyspark.sql import functions as F

from claimloom.functions import patterns as P
from claimloom.operators import classify as C
from claimloom.operators import scoring as S


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, t string")


def test_groups_against_contains(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé😀 ") for _ in range(n))
    groups = [[word(rng.randint(1, 3)) for _ in range(rng.randint(0, 6))] for _ in range(20)] + [["", "a"], ["abc", "bc", "c", "bc"]]
    texts = [None, "", *[word(rng.randint(0, 30)) for _ in range(200)], "ab" * 50_000]
    d = rows(spark, texts)
    want = [None if t is None else [sum(k in t for k in set(g)) for g in groups] for t in texts]
    got = [r.h for r in d.select("k", P.group_hits(F.col("t"), groups).alias("h")).orderBy("k").collect()]
    assert [None if h is None else [(x.at, x.n) for x in h] for h in got] == [None if w is None else [(at, n) for at, n in enumerate(w) if n] for w in want]
    assert [r.h for r in d.select("k", P.hit_counts(F.col("t"), groups).alias("h")).orderBy("k").collect()] == want
    few = groups[:3]
    assert [r.h for r in d.select("k", P.hit_counts(F.col("t"), few).alias("h")).orderBy("k").collect()] == [None if w is None else w[:3] for w in want]
    for keywords in ([k for g in groups for k in g if k], groups[3]):
        first = [None if t is None else next((at for at, k in enumerate(keywords) if k in t), None) for t in texts]
        assert [r.h for r in d.select("k", P.first_hit(F.col("t"), keywords).alias("h")).orderBy("k").collect()] == first
    assert d.select(P.group_hits(F.col("t"), []).alias("h")).where("size(h) > 0").isEmpty()


def test_wide_and_narrow_taxonomies_agree(spark, monkeypatch):
    rng = random.Random(6)
    one = spark.createDataFrame([(p, f"L{p}", "".join(rng.choice("abcd") for _ in range(3))) for p in range(4) for _ in range(5)] + [(9, "empty", None)], "pos int, label string, keyword string")
    two = spark.createDataFrame([(f"L{p % 4}", p, "same" if p % 3 == 0 else f"S{p}", "".join(rng.choice("abcd") for _ in range(2))) for p in range(9) for _ in range(3)], "level1 string, pos int, label string, keyword string")
    d = rows(spark, [None, "", *["".join(rng.choice("abcdeA ") for _ in range(rng.randint(1, 60))) for _ in range(300)]])
    by = {}
    for few in (0, 10_000):
        monkeypatch.setattr(C, "FEW", few)
        by[few] = [tuple(r) for r in C.classify(d, one, two, "k", "t").select("k", "level1", "conf1", "level2", "conf2").orderBy("k").collect()]
    monkeypatch.setattr(C, "FEW", 0)
    monkeypatch.setattr(C, "MOST_KEYWORDS", 3)
    assert by[0] == by[10_000] == [tuple(r) for r in C.classify(d, one, two, "k", "t").select("k", "level1", "conf1", "level2", "conf2").orderBy("k").collect()]
    assert len({r[3] for r in by[0]}) > 4


def test_wide_cue_and_source_tables(spark, monkeypatch):
    monkeypatch.setattr(S, "LONG_TABLE", 24)
    table = [(f"host{k}.org", k / 100) for k in range(60)]
    d = spark.createDataFrame([("Host7.org", None), ("x", "https://host59.org/host3.org"), ("host5", ""), (None, None), ("host10.org", "host1.org")], "source string, url string")
    src, url = F.lower(F.coalesce("source", F.lit(""))), F.lower(F.coalesce("url", F.lit("")))
    assert [r[0] for r in d.select(S.table_credibility(src, url, table)).collect()] == [0.07, 0.03, None, None, 0.01]
    cues = [f"cue{k}x" for k in range(40)]
    assert [r[0] for r in rows(spark, ["cue1x cue2x cue1x", "none", None]).select(S.cue_hits(F.col("t"), cues)).collect()] == [2, 0, None]
    d = spark.createDataFrame([("a b c d e", "up a b c d e x"), ("a", "down even even"), ("x", None), ("x", "")], "claim string, t string")
    pad = [f"never{k}" for k in range(30)]
    few = d.select(S.keyword_stance("claim", "t", ["up", "a"], ["down"], ["even", "up"]).alias("p")).collect()
    assert few == d.select(S.keyword_stance("claim", "t", ["up", "a", *pad], ["down"], ["even", "up"]).alias("p")).collect()
