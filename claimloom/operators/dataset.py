"""Dataset building: labels, conflicts, balancing, splits, negatives. Random choices are md5 orders with a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import LABELS


def draw(seed: str, *keys: str) -> Column:
    """A reproducible order: md5 of the seed and the keys."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def numbered(rows: DataFrame, by: list[str], keys: list[str], seed: str) -> DataFrame:
    """rows with _k, the place in its group in drawn order, from 1, and _n, the group's size.

    A draw's first three digits part each group into 4096 runs of its order. Places are counted within a run, and what
    stands before it comes from the runs' counts, so that a group may hold any share of the rows.
    """
    d = rows.withColumn("_d", draw(seed, *keys)).withColumn("_b", F.substring("_d", 1, 3))
    runs = d.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    w = W.partitionBy(*by)
    runs = runs.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_b").alias("_run"), F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(w).alias("_n"))
    within = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_d", *keys))
    same = F.col("_b") == F.col("_run")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = d.withColumn("_within", within).join(runs, same).withColumn("_k", F.col("_before") + F.col("_within"))
    return out.select(*rows.columns, "_k", "_n")


def canonical_label(c: Column, table: dict[str, str] = LABELS) -> Column:
    """The label that a name stands for, null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.lower(F.trim(c.cast("string"))))


def resolve_conflicts(rows: DataFrame, keys: list[str], label: str, pos: str) -> DataFrame:
    """One row for each key: its first row of the most frequent label, the alphabetically first of equals."""
    n = F.count("*").over(W.partitionBy(*keys, label))
    r = rows.withColumn("_n", n).withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), label, pos)))
    return r.where("_k = 1").drop("_n", "_k")


def distinct_rows(rows: DataFrame, keys: list[Column], pos: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(pos)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def split(rows: DataFrame, stratum: list[str], keys: list[str], seed: str, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """rows with `split`. A stratum of n rows gives max(1, round(n * ratio)) to test and to val, half-even; of two rows one
    goes to test, a single row to train."""
    r = numbered(rows, stratum, keys, seed)
    part = lambda x: F.greatest(F.lit(1), F.bround(F.col("_n") * x, 0).cast("int"))
    n_test = F.when(F.col("_n") == 1, 0).otherwise(part(test))
    n_val = F.when(F.col("_n") <= 2, 0).otherwise(part(val))
    return r.withColumn("split", F.when(F.col("_k") <= n_test, "test").when(F.col("_k") <= n_test + n_val, "val").otherwise("train")).drop("_k", "_n")


def balance(rows: DataFrame, by: list[str], keys: list[str], seed: str, within: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """As many rows of each group as the smallest has (within each of `within`), or at most cap, in drawn order.

    A given cap is a window's limit, which Spark also applies before its shuffle.
    """
    if cap is not None:
        r = rows.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(draw(seed, *keys), *keys)))
        return r.where(F.col("_k") <= cap).drop("_k")
    r = numbered(rows, by, keys, seed).drop("_n")
    n = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    if within:
        least = n.groupBy(*within).agg(F.min("_n").alias("_least"))
        return r.join(least, within).where("_k <= _least").drop("_k", "_least")
    return r.crossJoin(F.broadcast(n.agg(F.min("_n").alias("_least")))).where("_k <= _least").drop("_k", "_least")


def to_quotas(rows: DataFrame, label: str, keys: list[str], quotas: dict[str, int], seed: str) -> DataFrame:
    """Exactly quotas[label] rows of each label in drawn order, its rows repeated in turn where it has too few; `copy` counts."""
    q = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    r = numbered(rows.where(F.element_at(q, F.col(label)) > 0), [label], keys, seed)
    r = r.withColumn("_q", F.element_at(q, F.col(label))).where("_k <= _q")
    copies = (F.floor((F.col("_q") - F.col("_k")) / F.col("_n")) + 1).cast("int")
    return r.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("_q", "_k", "_n")


def target_counts(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Rounded quotas; the last label gets the remainder."""
    names = list(shares)
    out = {k: round(total * shares[k]) for k in names[:-1]}
    return out | {names[-1]: total - sum(out.values())}


def mismatched(rows: DataFrame, by: list[str], key: str, text: str, seed: str) -> DataFrame:
    """key, text of another row: rows of a group in drawn order, each with the next one's text; single rows give none."""
    r = numbered(rows, by, [key], seed).where("_n > 1")
    after = r.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_k").alias("_at"), F.col(text).alias("other"), F.col(key).alias("other_key"))
    same = F.col("_k") % F.col("_n") + 1 == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return r.join(after, same).select(*rows.columns, "other", "other_key")


def augment(rows: DataFrame, text: str, templates: list[str], need: int, keys: list[str], seed: str) -> DataFrame:
    """`need` new texts from templates with {} for a row's text, distinct from the rows' and from each other."""
    made = rows.withColumn("template", F.explode(F.array(*[F.lit(t) for t in templates]))).withColumn("made", F.replace(F.col("template"), F.lit("{}"), F.col(text)))
    made = made.join(rows.select(F.col(text).alias("made")).distinct(), "made", "left_anti")
    one = made.withColumn("_k", F.row_number().over(W.partitionBy("made").orderBy(*keys, "template"))).where("_k = 1").drop("_k")
    return one.orderBy(draw(seed, *keys, "template"), *keys, "template").limit(need)


def overlap_counts(rows: DataFrame, part: str, key: str) -> DataFrame:
    """part_a, part_b, n: how many distinct keys two parts share; one row for each pair of parts."""
    d = rows.select(part, key).distinct()
    per = d.groupBy(key).agg(F.sort_array(F.collect_set(part)).alias("p"))
    pairs = per.select(F.explode(F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(a.alias("part_a"), b.alias("part_b")))))).alias("x"))
    return pairs.groupBy("x.part_a", "x.part_b").agg(F.count("*").alias("n"))


def missing_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Combinations of the values of two label columns that no row has: for each value of a, those of b less its own."""
    own = rows.where(F.col(a).isNotNull()).groupBy(a).agg(F.collect_set(b).alias("_own"))
    every = rows.agg(F.collect_set(b).alias("_every"))
    return own.join(F.broadcast(every)).select(a, F.explode(F.array_except("_every", "_own")).alias(b))
