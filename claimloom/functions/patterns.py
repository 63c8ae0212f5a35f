"""Many keywords in one pass over a text, whatever their number."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship

#: Keywords up to which a `contains` for each, in generated code, is the cheaper plan.
FEW = 24


class Keywords:
    """An automaton over all keywords of some groups, which reads a text once and tells what it contains."""

    def __init__(self, groups: Sequence[Sequence[str]]):
        import ahocorasick

        of: dict[str, list[int]] = {}
        for at, keywords in enumerate(groups):
            for k in dict.fromkeys(keywords):
                of.setdefault(k, []).append(at)
        self.always = of.pop("", [])  # every text contains the empty keyword
        self.groups = list(of.values())
        self.find = None
        if of:
            self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for number, k in enumerate(of):
                self.find.add_word(k, number)
            self.find.make_automaton()

    def counts(self, text: str) -> tuple[list[int], list[int]]:
        """The groups of which the text contains a keyword, ascending, and how many different ones of each."""
        found = {number for _, number in self.find.iter(text)} if self.find else ()
        n: dict[int, int] = dict.fromkeys(self.always, 1)
        for number in found:
            for at in self.groups[number]:
                n[at] = n.get(at, 0) + 1
        at = sorted(n)
        return at, [n[a] for a in at]


@lru_cache(maxsize=8)
def compiled(groups: tuple[tuple[str, ...], ...]) -> Keywords:
    return Keywords(groups)


def group_hits(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """array<struct<at: int, n: int>>: the groups of which the text contains a keyword as a substring, by their numbers from
    0 and ascending, with how many of their different keywords it contains. A null text is null; a keyword may be in several
    groups, may lie within another, and is compared as it is. The groups go with the plan: they are tables of at most some
    ten thousand keywords. One automaton a worker is built for them; a text costs its length and its matches.
    """
    ship(SparkSession.active())
    held = tuple(tuple(g) for g in groups)

    def run(texts: pa.Array) -> pa.Array:
        words = compiled(held)
        at, n, sizes = [], [], [0]
        for t in texts:
            t = t.as_py()
            if t is not None:
                a, b = words.counts(t)
                at += a
                n += b
            sizes.append(len(at))
        entries = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int32())], ["at", "n"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entries, mask=texts.is_null())

    return F.arrow_udf(run, "array<struct<at:int,n:int>>")(text)


def first_hit(text: Column, keywords: Sequence[str]) -> Column:
    """The number, from 0, of the first of the keywords, in their order, that the text contains; null where it has none."""
    if len(keywords) <= FEW:
        out = F.lit(None).cast("int")
        for at, k in reversed(list(enumerate(keywords))):
            out = F.when(F.contains(text, F.lit(k)), at).otherwise(out)
        return out
    return F.get(group_hits(text, [[k] for k in keywords]), F.lit(0))["at"]


def hit_counts(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """array<int>: for each group how many of its different keywords the text contains; null for a null text."""
    if sum(map(len, groups)) <= FEW:
        one = lambda g: sum((F.contains(text, F.lit(k)).cast("int") for k in dict.fromkeys(g)), F.lit(0))
        return F.when(text.isNotNull(), F.array(*[one(g) for g in groups]))
    hits = F.transform(F.array(group_hits(text, groups)), lambda h: F.map_from_entries(h))[0]
    return F.when(hits.isNotNull(), F.array(*[F.coalesce(F.element_at(hits, at), F.lit(0)) for at in range(len(groups))]))
