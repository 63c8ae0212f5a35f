"""Central sentences against a walk over a whole table of pairs."""

import math
import random

from claimloom import queries_rest as Q
from claimloom.functions import text as X
from claimloom.operators import summaries as S


def plain(texts, most):
    n = len(texts)
    if n <= most:
        return list(range(n))
    sets = [set(S.WORD.findall((t or "").lower())) for t in texts]
    like = [[len(a & b) / math.sqrt(len(a) * len(b)) if a and b and i != j else 0.0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    degree = [sum(r) for r in like]
    rank = [1 / n] * n
    for _ in range(S.STEPS):
        idle = sum(r for r, d in zip(rank, degree, strict=True) if d <= 1e-9)
        rank = [(1 - S.DAMPING) / n + S.DAMPING * (sum(rank[j] / degree[j] * like[j][i] for j in range(n) if degree[j] > 1e-9) + idle / n) for i in range(n)]
    return sorted(sorted(range(n), key=lambda i: (-round(rank[i], S.DIGITS), i))[:most])


def test_against_all_pairs():
    rng = random.Random(4)
    for n in (1, 2, 4, 9, 40):
        for _ in range(8):
            texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta to of".split()) for _ in range(rng.randint(0, 6))) for _ in range(n)]
            for most in (1, 3):
                assert S.central(texts, most) == plain(texts, most)
    assert S.central([], 3) == [] and S.central(["", None, "1", "2"], 2) == [0, 1]
    assert S.central(["rain fell on the town", "the town had rain all day", "a goat", "rain in the old town again"], 1) in ([0], [1], [3])


def test_long_texts_need_no_table_of_pairs():
    texts = [f"word{k % 997} common thing{k % 31} again" for k in range(60_000)]
    assert len(S.central(texts, 5)) == 5


def test_summaries(spark, sf):
    d = spark.createDataFrame([(1, "Rain fell on the old town. A goat. The town had rain all day. Rain in the town again!"), (2, None), (3, ""), (4, "One sentence only here")], "id int, text string")
    got = {r.id: (r.positions, r.summary) for r in S.summaries(d, ["id"], most=2).collect()}
    assert got[2] == ([], "") == got[3] and got[4] == ([0], "One sentence only here")
    assert len(got[1][0]) == 2 and 1 not in got[1][0]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cut = {r.doc_id: r.s for r in docs.select("doc_id", X.sentences("text").alias("s")).collect()}
    rows = {r.doc_id: r for r in Q.x4(spark, sf).collect()}
    assert len(rows) == len(cut)
    for k, s in cut.items():
        if len(s or []) <= 40:
            assert rows[k].positions == ",".join(map(str, plain(s or [], 3)))
