"""Numbers, components and similar sets of any size: what order-dependent operators need, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.session import ship, staged

#: Rows of a small side up to which it is broadcast; numbers of 8 bytes alone.
BROADCAST_ROWS, BROADCAST_NODES = 100_000, 1_000_000
#: Words that are looked for in one slice.
PROBES = 10_000_000
#: Most bits of a bitmap's places, and bytes of a bucket of Spark's bitmaps.
BITS, BUCKET = 28, 4096
#: Common words that are told apart from rare ones, and the share of sets, one in so many, that tells them.
COMMON, SAMPLED = 200_000, 8
#: Words of a set for each further one that has to be found before its pair is confirmed.
STEP = 40


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a hint to broadcast it if it has few rows; counted, so it should be cheap to read."""
    return F.broadcast(df) if df.count() <= most else df


def number(rows: DataFrame, by: list[str], order: list[Column | str], name: str, partitions: int | None = None) -> DataFrame:
    """rows with `name`: 1, 2, ... within each group of `by`, in the order given, which must be total for a stable result.

    Rows are dealt out by ranges of (by, order), so that a group of any size lies in as many partitions as its rows need,
    sorted there, and written with their places in their partitions. What comes before a group's rows of one partition is
    summed over a table of one row for each partition and group. No window or task spans a group.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    asc = [k if isinstance(k, Column) else F.col(k).asc_nulls_first() for k in keys]
    at = staged(rows.repartitionByRange(n, *asc).sortWithinPartitions(*asc).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    at = at.withColumn("_part", F.shiftright("_id", 33))
    runs = at.groupBy(*by, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = staged(runs.withColumn("_before", before).select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_run"), "_first", "_before"), "runs")
    same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
    condition = F.col("_part") == F.col("_run")
    for s in same:
        condition = condition & s
    out = at.join(small(runs), condition)
    return out.withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_id", "_part", "_run", "_first", "_before", *[f"_by{k}" for k in range(len(by))])


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges(a, b): comp is the smallest node that it is linked with.

    Rounds of hooking every node's larger neighbours, then its smaller ones, to the smallest, until no edge changes; what a
    round looks up is written first, so that a node of many edges is a partial aggregate and a join that adaptive execution
    splits.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    was = mark(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u"), "low")
        large = both.join(low, both.a == low.u).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.distinct(), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "least")
        hooked = large.join(least, large.a == least.u)
        after = hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(hooked.select("a", F.col("m").alias("b"))).distinct()
        now = staged(after, "edges")
        new = mark(now)
        if new == was:
            break
        was = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def _marked(places: DataFrame, bits: int, at_least: int = 1) -> np.ndarray:
    """A bitmap of 2 ** bits places, as bytes: those that `place` names at_least times."""
    once = places.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    parts = once.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("b"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.collect():
        out[(r.k - 1) * BUCKET : r.k * BUCKET] = np.frombuffer(bytes(r.b), np.uint8)
    return out


def _is_marked(marked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & (len(marked) * 8 - 1)
    return (marked[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def similar_sets(sets: DataFrame, above: float) -> DataFrame:
    """(x, y): pairs of sets(node, words, g) of which more than a share `above` of the smaller one's words is in the larger one.
    words are distinct longs, not empty; only sets of one group g, if there is such a column, meet.

    If so, at most m = floor((1 - above) * size) of the smaller set's words are not in the larger. A word that no other set of
    the group has is one of these: a set of more than m such is in no other. Else a set of u such is looked for by m - u + k
    of its other words, rare ones first, among all words of the others, and only where k of them are found (k: 2, or 1 and one
    for every STEP words) whole sets meet. One shared rare word makes most candidates of random texts, and a whole set
    shuffled for each of them costs many times the input.
    Common words are the COMMON most frequent ones of every SAMPLED-th set. The others are counted by their hashes' last bits in a
    bitmap of up to BITS, so that "no other" is sure and its contrary is not; and a bitmap of the words that sets are looked for by
    leaves of the sets what may be found. Both change the work, not the result. So a few hundredths of the words are
    shuffled. Pairs are confirmed on their whole sets, so that sets which are all alike cost as many confirmations as pairs.
    What is looked for comes in slices of about PROBES words, of which one at a time is on disk.
    """
    spark = sets.sparkSession
    ship(spark)
    sets = sets.select("node", "words", F.col("g") if "g" in sets.columns else F.lit(0).cast("long").alias("g"))
    n_words = sets.agg(F.sum(F.size("words"))).first()[0] or 0
    bits = min(BITS, max(18, (4 * n_words).bit_length()))
    some = sets.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0).select(F.explode("words").alias("w"))
    often = some.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(COMMON).toPandas().sort_values("w")
    often = spark.sparkContext.broadcast((often["w"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))

    def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sizes of the batch's sets, and of all their words: whose, and with its group as one hash."""
        sizes = b.column("words").value_lengths().to_numpy()
        of = np.repeat(np.arange(len(sizes)), sizes)
        return sizes, of, b.column("words").flatten().to_numpy() ^ b.column("g").to_numpy()[of]

    def sampled(b: pa.RecordBatch) -> np.ndarray:
        """How often the sample has each word of the batch's sets."""
        words, (w, n) = b.column("words").flatten().to_numpy(), often.value
        at = np.minimum(np.searchsorted(w, words), max(0, len(w) - 1))
        return np.where(w[at] == words, n[at], 0) if len(w) else np.zeros(len(words), np.int64)

    def rare(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(flat(b)[2][sampled(b) == 0] & ((1 << bits) - 1))], ["place"])

    several = spark.sparkContext.broadcast(_marked(sets.mapInArrow(rare, "place long"), bits, 2))

    def rarest(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (sizes, of, keys), n = flat(b), sampled(b)
            left = (n > 0) | _is_marked(several.value, keys)
            others = np.bincount(of[left], minlength=len(sizes))
            missed = np.floor((1 - above) * sizes + 1e-6).astype(np.int64) - (sizes - others)
            taken = np.where(missed < 0, 0, np.minimum(others, missed + np.maximum(2, 1 + sizes // STEP)))
            of, n, keys = of[left], n[left], keys[left]
            order = np.lexsort((keys, n, of))
            of, keys = of[order], keys[order]
            first = np.arange(len(of)) - np.repeat(np.cumsum(others) - others, others) < taken[of]
            of, keys = of[first], keys[first]
            least = np.maximum(1, taken - missed)
            yield pa.RecordBatch.from_arrays([pa.array(b.column("node").to_numpy()[of]), pa.array(sizes[of].astype(np.int32)), pa.array(least[of].astype(np.int32)), pa.array(keys)], ["x", "nx", "least", "w"])

    probe = staged(sets.mapInArrow(rarest, "x long, nx int, least int, w long"), "probes")
    mask = (1 << bits) - 1
    slices = max(1, -(-probe.count() // PROBES))
    similar = []
    for k in range(slices):
        mine = probe if slices == 1 else probe.where(F.pmod(F.xxhash64("x"), F.lit(slices)) == k)
        sought = spark.sparkContext.broadcast(_marked(mine.select(F.col("w").bitwiseAND(F.lit(mask)).alias("place")), bits))

        def looked_for(batches, sought=sought) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes, of, keys = flat(b)
                found = _is_marked(sought.value, keys)
                of = of[found]
                yield pa.RecordBatch.from_arrays([pa.array(b.column("node").to_numpy()[of]), pa.array(sizes[of].astype(np.int32)), pa.array(keys[found])], ["y", "ny", "w"])

        found = mine.join(sets.mapInArrow(looked_for, "y long, ny int, w long"), "w").where("x <> y AND nx <= ny")
        pairs = found.groupBy("x", "y").agg(F.count("*").alias("n"), F.first("least").alias("least"), F.first(F.col("nx") == F.col("ny")).alias("even")).where("n >= least")
        turned = F.col("even") & (F.col("x") > F.col("y"))
        pairs = staged(pairs.select(F.when(turned, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("y")).distinct(), "pairs")
        ends = {c: small(pairs.select(F.col(c).alias("node")).distinct(), BROADCAST_NODES) for c in "xy"}
        of = lambda c, ends=ends: sets.join(ends[c], "node", "left_semi").select(F.col("node").alias(c), F.col("g").alias(f"g{c}"), F.col("words").alias(f"w{c}"))
        both = pairs.join(of("x"), "x").join(of("y"), "y").where("gx = gy")
        both = both.where(F.size(F.array_intersect("wx", "wy")) / F.least(F.size("wx"), F.size("wy")) > above).select("x", "y")
        similar.append(both if slices == 1 else staged(both, "some"))
    return similar[0] if slices == 1 else reduce(DataFrame.unionByName, similar).distinct()
