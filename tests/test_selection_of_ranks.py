"""Values at ranks, exactly, without a task that holds them all."""

import random
import statistics

import pytest

from claimloom.operators import evaluate as E


@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "two", "one", "infinite"])
def test_medians(spark, monkeypatch, kind):
    rng = random.Random(2)
    values = {
        "spread": [rng.gauss(0, 1) ** 5 for _ in range(4001)], "ties": [float(rng.choice([1, 2, 2, 2, 3, 9])) for _ in range(4000)], "equal": [7.0] * 3000,
        "two": [0.0] * 1500 + [1.0] * 1500, "one": [3.5], "infinite": [float("inf")] * 900 + [float("-inf")] * 900 + [1.0] * 2,
    }[kind]
    d = spark.createDataFrame([(x,) for x in [*values, None]], "v double").repartition(4)
    for most in (20, 10**6):
        ranks = [0, len(values) // 3, len(values) // 2, len(values) - 1]
        assert E.at_ranks(d.where("v IS NOT NULL"), ranks, most) == [sorted(values)[r] for r in ranks]
    assert E.exact_median(d, "v") == pytest.approx(statistics.median(values))


def test_no_values(spark):
    assert E.exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None
