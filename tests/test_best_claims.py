"""The best claim of a document, which stays one row."""

import re

from claimloom.functions import text as X
from claimloom.operators import greedy as G
from claimloom.plans import verify as P

LONG = "The committee of the city number {0} reported that {0} houses were affected by flooding of river {0} in 2019 and after."
PLAIN = "we walk along small green paths near old mills while birds sing, and water runs all day"


def test_documents_are_not_shuffled(spark):
    d = spark.createDataFrame([(1, LONG.format(7))], "d long, t string")
    plan = P.best_claims(d, "d", "t")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Window|Join|Sort", plan) and plan.count("ArrowEvalPython") == 1


def test_documents_of_any_length(spark):
    many = " ".join(f"{LONG.format(k)} x" for k in range(400))
    rows = [(1, f"{PLAIN}. {LONG.format(7)}"), (2, many), (3, f"{PLAIN}."), (4, None), (None, LONG.format(7)), (5, f"{PLAIN}. " * 3)]
    got = {r.d: (r.sentence, r.score) for r in P.best_claims(spark.createDataFrame(rows, "d long, t string"), "d", "t").collect()}
    assert set(got) == {1, 2, 3, None, 5}
    assert got[1][0] == LONG.format(7) and got[2][0] == LONG.format(0) and got[1][1] > 7
    assert got[3] == (f"{PLAIN}.", None) and got[5] == (f"{PLAIN}.", None) and got[None] == (LONG.format(7), None)


def test_candidates_against_rows(spark):
    """Sentences, then neighbours, as `distinct_claims` keeps rows of them."""
    s = [(f"w{k % 7} a{k % 5} b{k % 3} c{k}" if k % 4 else "same words here", 4 if k % 4 else 3, k % 3 > 0) for k in range(60)]
    for part in (s, s[:9], s[:1], []):
        rows = [(1, k, x) for k, (x, _, ok) in enumerate(part) if ok]
        rows += [(1, 1000 + k, f"{a[0]} {b[0]}") for k, (a, b) in enumerate(zip(part, part[1:])) if (a[2] or b[2]) and 8 <= a[1] + b[1] <= 80]
        want = [r.sentence for r in G.distinct_claims(spark.createDataFrame(rows, "d int, pos int, sentence string"), "d", "pos").orderBy("pos").collect()]
        d = spark.createDataFrame([(None,), (part,)], "s array<struct<sentence:string,n:int,ok:boolean>>")
        assert [r.k for r in d.select(G.distinct_sentences(d.s, 8, 80).alias("k")).collect()] == [[], want]


def test_spaces_of_all_kinds(spark):
    odd = ["a  b", " a\t b\x85c \n", "　", "", "a b", "\x1ca  b.\n\n c", "a​b c"]
    d = spark.createDataFrame([(x,) for x in odd], "t string")
    got = [(r.c, r.n) for r in d.select(X.collapse("t").alias("c"), X.word_count("t").alias("n")).collect()]
    assert got == [(" ".join(x.split()), len(x.split())) for x in odd]
    short = f"Too short. {PLAIN}.  U. S. A few | more"
    r = spark.createDataFrame([(short,)], "t string").select(X.claim_sentences("t").alias("all"), X.claim_sentences("t", 15).alias("long")).first()
    assert r.long == [x for x in r.all if len(x.split()) >= 15] == [f"{PLAIN}."]
