"""The sentences that a document's others resemble most: a pick or a summary without a model."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..plans.session import ship

#: Letters of a word, the damping of the walk over sentences, its steps, and the digits to which places are compared.
WORD = re.compile("[A-Za-zऀ-ൿ]{3,}")
DAMPING, STEPS, DIGITS = 0.85, 40, 9


def centrality(texts: list[str]) -> np.ndarray:
    """The share of a random walk over sentences that each holds: steps go by the cosine of their word sets, and with
    1 - DAMPING anywhere. A step is two sums over words and sentences, so that the work grows with the text and no table of
    pairs is made."""
    n = len(texts)
    names: dict[str, int] = {}
    sets = [sorted({names.setdefault(w, len(names)) for w in WORD.findall((t or "").lower())}) for t in texts]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    row, word = np.repeat(np.arange(n), size), np.array([w for s in sets for w in s], dtype=np.int64)
    value = 1 / np.sqrt(np.maximum(size, 1))[row]
    has = (size > 0).astype(float)

    def step(x: np.ndarray) -> np.ndarray:
        by_word = np.bincount(word, value * x[row], len(names) or 1)
        return np.maximum(np.bincount(row, value * by_word[word], n) - has * x, 0.0) if len(row) else np.zeros(n)

    degree = step(np.ones(n))
    linked = degree > 1e-9
    rank = np.full(n, 1 / n)
    for _ in range(STEPS):
        moved = step(np.where(linked, rank / np.where(linked, degree, 1.0), 0.0))
        rank = (1 - DAMPING) / n + DAMPING * (moved + rank[~linked].sum() / n)
    return rank


def central(texts: list[str], most: int) -> list[int]:
    """Positions of the `most` most central sentences, in order; of equals, to DIGITS digits, the first ones."""
    if len(texts) <= most:
        return list(range(len(texts)))
    rank = np.round(centrality(texts), DIGITS)
    return sorted(np.lexsort((np.arange(len(texts)), -rank))[:most].tolist())


def central_positions(texts: Column, most: int = 3) -> Column:
    """array<int>: positions, from 0 and ascending, of the most central of an array of sentences; null for null."""
    ship(SparkSession.active())

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else central(r, most) for r in rows.to_pylist()], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(texts)


def summaries(docs: DataFrame, keep: list[str], text: str = "text", most: int = 3) -> DataFrame:
    """keep, positions, summary: the most central sentences of each text, in its order; with most=1 the claim to pick. A null
    or empty text has an empty summary. A document is one row throughout, so nothing is shuffled."""
    d = docs.select(*keep, F.coalesce(sentences(text), F.array().cast("array<string>")).alias("_s"))
    d = d.withColumn("positions", central_positions(F.col("_s"), most))
    return d.select(*keep, "positions", F.array_join(F.transform("positions", lambda k: F.get("_s", k)), " ").alias("summary"))
