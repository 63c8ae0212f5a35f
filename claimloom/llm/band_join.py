"""Numeric band join: for each key the values near it, their totals and the nearest of them, by a digit trie over the values."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, stage

#: Leading digits that name a block of the trie, and the least width of one.
DIGITS, WIDTH = 2, 100
#: Leaves or keys of a block from which blocks get more digits.
LEAVES = 100_000
#: A p with more than one in HOT of all keys is salted; there are fewer than HOT of them.
HOT = 1000
TOP = 1 << 60


def block_of(x, digits: int):
    """The first value of x's block: a value keeps its leading digits, but for the last two at least."""
    size = F.length(F.abs(x).cast("string"))
    step = F.greatest(F.lit(WIDTH).cast("long"), F.pow(F.lit(10.0), F.greatest(size - digits, F.lit(0))).cast("long"))
    return x - F.pmod(x, step)


def blocks_between(lo, hi, digits: int):
    """The blocks that values from lo to hi may lie in."""
    size = F.length(F.least(F.abs(lo), F.abs(hi)).cast("string"))
    near = F.when((lo > 0), F.pow(F.lit(10.0), F.greatest(size - digits, F.lit(0))).cast("long")).otherwise(F.lit(WIDTH).cast("long"))
    step = F.greatest(F.lit(WIDTH).cast("long"), near)
    return F.array_distinct(F.transform(F.concat(F.sequence(lo, hi, step), F.array(hi)), lambda x: block_of(x, digits)))


class Trie:
    """A block's values as a trie of decimal digits; each node has the sums of its subtree."""

    def __init__(self, u: np.ndarray, sums: np.ndarray):
        self.u, self.sums = u, sums
        self.keys, self.before, self.first = [u], [], []
        span = int(u[-1] - u[0]) if len(u) else 0
        while 10 ** len(self.keys) <= 10 * span:
            k = self.keys[-1] // 10
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            self.first.append(np.r_[at, len(k)])
            self.keys.append(k[at])
        level = sums
        for j in range(len(self.keys)):
            if j:
                level = np.add.reduceat(level, self.first[j - 1][:-1], axis=0)
            self.before.append(np.vstack([np.zeros((1, sums.shape[1]), dtype=sums.dtype), np.cumsum(level, axis=0)]))

    def below(self, x: np.ndarray) -> np.ndarray:
        """Sums over all values under each x: on the way down to x, the subtrees of smaller digits at each level."""
        out = np.zeros((len(x), self.sums.shape[1]), dtype=self.sums.dtype)
        for j in range(len(self.keys) - 1, -1, -1):
            k = x // 10**j
            end = np.searchsorted(self.keys[j], k)
            start = 0 if j == len(self.keys) - 1 else np.searchsorted(self.keys[j], k // 10 * 10)
            out += self.before[j][end] - self.before[j][start]
        return out

    def by_gap(self, p: int, lo: int, hi: int):
        """Positions of the leaves in lo..hi by (distance from p, value): the nearest node is opened first."""
        heap = []

        def push(level: int, a: int, b: int) -> None:
            size = 10**level
            for at in range(a, b):
                low = int(self.keys[level][at]) * size
                high = low + size - 1
                if low <= hi and high >= lo:
                    heapq.heappush(heap, (max(low - p, p - high, 0), level == 0, low, level, at))

        top = len(self.keys) - 1
        push(top, 0, len(self.keys[top]))
        while heap:
            gap, _, _, level, at = heapq.heappop(heap)
            if level == 0:
                yield gap, at
            else:
                push(level - 1, int(self.first[level - 1][at]), int(self.first[level - 1][at + 1]))


def answers(leaves: pa.Table, asks: pa.Table, k: int, owner: str, out: pa.Schema) -> pa.Table:
    """For each asked interval of a block: totals of its values, and lines enough for the first k of any owner's others."""
    order = np.argsort(leaves.column("u").to_numpy())
    leaves = leaves.take(pa.array(order))
    u = leaves.column("u").to_numpy()
    start = int(u[0]) if len(u) else 0
    n, w = leaves.column("n").to_numpy(), leaves.column("w").to_numpy()
    trie = Trie(u, np.stack([n, n * (u - start), w], 1))
    p, lo, hi = (asks.column(c).to_numpy() for c in ("p", "lo", "hi"))
    a, m, b = trie.below(lo), trie.below(p), trie.below(hi + 1)
    left, right = m - a, b - m
    gaps = (right[:, 1] - (p - start) * right[:, 0]) + ((p - start) * left[:, 0] - left[:, 1])
    lists = leaves.column("lines").combine_chunks()
    offsets, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
    owners = flat.field(owner).dictionary_encode().indices.to_numpy()
    took, took_gap, took_u, sizes = [], [], [], []
    for q in range(len(p)):
        seen: dict[int, int] = {}
        size = most = 0
        for gap, at in trie.by_gap(int(p[q]), int(lo[q]), int(hi[q])):
            for line in range(offsets[at], offsets[at + 1]):
                mine = seen.get(owners[line], 0)
                if mine < k:
                    seen[owners[line]] = mine + 1
                    most, size = max(most, mine + 1), size + 1
                    took.append(line)
                    took_gap.append(gap)
                    took_u.append(u[at])
            if size - most >= k:
                break
        sizes.append(size)
    lines = flat.take(pa.array(took, pa.int64()))
    kind = out.field("lines").type
    fields = [pa.array(took_gap, pa.int64()), pa.array(took_u, pa.int64()), *(lines.field(f.name).cast(f.type) for f in list(kind.value_type)[2:])]
    entries = pa.StructArray.from_arrays(fields, fields=list(kind.value_type))
    near = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), entries)
    return pa.table([asks.column("p"), pa.array(left[:, 0] + right[:, 0]), pa.array(gaps), pa.array(left[:, 2] + right[:, 2]), near.cast(kind)], schema=out)


def band(gap: int, permille: int):
    """The least and greatest u with |u - p| <= gap or 1000 |u - p| <= permille * min(u, p), of column p, in exact integers."""
    part = lambda base: F.expr(f"(p div {base}) * {permille} + ((p % {base}) * {permille}) div {base}")
    p, wide = F.col("p"), F.col("p") > 0
    return p - F.greatest(F.lit(gap), F.when(wide, part(1000 + permille)).otherwise(0)), p + F.greatest(F.lit(gap), F.when(wide, part(1000)).otherwise(0))


def band_join(keys: DataFrame, values: DataFrame, owner: str = "item_id", order: tuple[str, ...] = (), k: int = 10, gap: int = 50, permille: int = 5, leaves_most: int = LEAVES) -> DataFrame:
    """For each row of keys(owner, p), the values(owner, u, w, *order) of other owners with |u - p| <= gap or 1000 |u - p| <=
    permille * min(u, p): owner, p, n_pairs, gap_sum, w_sum over all of them, and near, the first k by (gap, u, *order, owner).

    p, u and w are longs, p and u below 2**60 in size. Repeated keys and values each count. Keys or values that are null in
    owner, p or u pair with nothing; such keys come out with zero totals and an empty `near`. Null order columns come first.
    Values meet keys as different u and different p: a leaf of the trie has the sums of its u and its first 2 k lines, of
    which k of one owner at most, so that k remain whoever asks. The trie is shuffled by the leading digits of u; an
    interval goes to the blocks that it touches (three at most with two digits), where three descents give its totals and a
    best-first walk its nearest lines. Blocks have more digits where one of them would have more than leaves_most leaves.
    An owner's own values are taken off its totals by a join of sums by (owner, u). No stage holds one row per line of a
    hot owner or a hot u. Keys of a common p are salted. Broadcast are only these p, fewer than HOT; collected is nothing
    but the largest block's size and the number of keys.
    """
    spark = keys.sparkSession
    bound_batches(spark)
    right = values.where(F.col(owner).isNotNull() & F.col("u").isNotNull() & (F.abs("u") < TOP)).select("u", owner, "w", *order)
    own = right.groupBy(owner, "u").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    mine = W.partitionBy("u", owner).orderBy(*order)
    line = F.struct(*order, owner)
    first = right.withColumn("_at", F.row_number().over(mine)).where(F.col("_at") <= k)
    first = first.withColumn("_at", F.row_number().over(W.partitionBy("u").orderBy(*order, owner, "_at"))).where(F.col("_at") <= 2 * k)
    tops = first.groupBy("u").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    leaves = own.groupBy("u").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).join(tops, "u")

    left = keys.select(owner, "p").groupBy(owner, "p").agg(F.count("*").alias("copies"))
    fine = F.col(owner).isNotNull() & F.col("p").isNotNull() & (F.abs("p") < TOP)
    lo, hi = band(gap, permille)
    asked = stage(left.where(fine).groupBy("p").agg(F.count("*").alias("owners")).withColumns({"lo": lo, "hi": hi}), "asked")
    share = (asked.agg(F.sum("owners")).first()[0] or 0) // HOT + 64
    hot = F.broadcast(asked.where(F.col("owners") > share).select("p", F.ceil(F.col("owners") / share).cast("int").alias("salts")))
    leaves, digits = stage(leaves, "leaves"), DIGITS
    sizes = leaves.select(block_of(F.col("u"), digits).alias("b")).unionAll(asked.select(block_of(F.col("p"), digits))).groupBy("b").count()
    most = sizes.agg(F.max("count")).first()[0] or 0
    while most > leaves_most and digits < 6:
        digits, most = digits + 1, most / 10

    entry = T.StructType([T.StructField("gap", T.LongType()), T.StructField("u", T.LongType()), *right.select(*order, owner).schema])
    longs = [T.StructField(c, T.LongType()) for c in ("p", "n", "gap_sum", "w")]
    schema = T.StructType([*longs, T.StructField("lines", T.ArrayType(entry))])
    out = to_arrow_schema(schema)

    def meet(_, leaf: pa.Table, ask: pa.Table) -> pa.Table:
        return answers(leaf, ask, k, owner, out) if leaf.num_rows and ask.num_rows else out.empty_table()

    asks = asked.withColumn("block", F.explode(blocks_between(F.col("lo"), F.col("hi"), digits)))
    dealt = leaves.withColumn("block", block_of(F.col("u"), digits))
    part = dealt.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(meet, schema)
    found = part.groupBy("p").agg(F.sum("n").alias("n"), F.sum("gap_sum").alias("gap_sum"), F.sum("w").alias("w"), F.sort_array(F.flatten(F.collect_list("lines"))).alias("lines"))

    within = left.where(fine).select(owner, "p", lo.alias("lo"), hi.alias("hi")).join(own, owner).where("u BETWEEN lo AND hi")
    off = within.groupBy(owner, "p").agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * F.abs(F.col("u") - F.col("p"))).alias("own_gap"), F.sum("w").alias("own_w"))
    found = found.join(hot, "p", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    salted = left.where(fine).join(off, [owner, "p"], "left").join(hot, "p", "left").withColumn("salt", F.pmod(F.xxhash64(owner), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    both = salted.join(found, ["p", "salt"], "left").unionByName(left.where(~F.coalesce(fine, F.lit(False))), allowMissingColumns=True)
    minus = lambda a, b: F.coalesce(F.col(a), F.lit(0)) - F.coalesce(F.col(b), F.lit(0))
    near = F.slice(F.filter("lines", lambda x: x[owner] != F.col(owner)), 1, k)
    near = F.coalesce(near, F.array().cast(T.ArrayType(entry)))
    each = both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(owner, "p", minus("n", "own_n").alias("n_pairs"), minus("gap_sum", "own_gap").alias("gap_sum"), minus("w", "own_w").alias("w_sum"), near.alias("near"))


def cents(x):
    """floor(100 x + 0.5) in doubles as a long; null where that is null, not finite or no long."""
    c = F.floor(x.cast("double") * 100 + 0.5)
    return F.when(F.abs(x.cast("double")) < TOP / 128, c)


def op13(spark, sf_dir: str) -> DataFrame:
    """item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc: each row of items with the first ten
    lines of other items at a near unit price, and the totals over all of them.

    Lines of quantity 0 have no unit price and pair with nothing, like those with a null or non-finite amount."""
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where("sale_id IS NOT NULL AND quantity <> 0")
    lines = lines.select("sale_id", F.col("line_no").cast("long").alias("line_no"), "item_id", F.col("quantity").cast("long").alias("q"), cents(F.col("amount")).alias("a"))
    lines = lines.withColumns({"num": F.signum("q").cast("long") * (2 * F.col("a") + F.col("q")), "den": 2 * F.abs("q")})
    text = F.concat_ws(",", F.col("sale_id").cast("string"), F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.col("item_id").cast("string"))
    values = lines.select("sale_id", "line_no", "item_id", F.expr("(num - pmod(num, den)) div den").alias("u"), F.crc32(text).alias("w"))
    items = spark.read.parquet(f"{sf_dir}/items.parquet").select("item_id", cents(F.col("price")).alias("p"))
    out = band_join(items, values, "item_id", ("sale_id", "line_no"))
    each = out.select("item_id", "n_pairs", "gap_sum", F.col("w_sum").alias("lines_crc"), F.posexplode_outer("near").alias("pos", "x"))
    rank = F.coalesce(F.col("pos") + 1, F.lit(0)).cast("int").alias("rank")
    return each.select("item_id", rank, "x.gap", "x.u", "x.sale_id", "x.line_no", F.col("x.item_id").alias("line_item_id"), "n_pairs", "gap_sum", "lines_crc")


OP13_SQL = """
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), l AS (
  SELECT sale_id, line_no::BIGINT AS line_no, item_id, CASE WHEN quantity < 0 THEN -1 ELSE 1 END * (2 * floor(100 * amount + 0.5)::HUGEINT + quantity) AS num, 2 * abs(quantity)::HUGEINT AS den,
    concat(sale_id, ',', coalesce(line_no::VARCHAR, ''), ',', item_id) AS s
  FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND amount IS NOT NULL AND quantity <> 0 AND isfinite(amount)
), v AS (
  SELECT sale_id, line_no, item_id, ((num - ((num % den) + den) % den) // den)::BIGINT AS u,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc
  FROM l, t
), i AS (
  SELECT row_number() OVER () AS r, item_id, CASE WHEN isfinite(price) THEN floor(100 * price + 0.5)::BIGINT END AS p FROM items
), j AS (
  SELECT r, v.item_id AS line_item_id, sale_id, line_no, u, abs(u - p) AS gap, crc
  FROM i JOIN v ON v.u BETWEEN p - greatest(50, p // 200) AND p + greatest(50, p // 200) AND v.item_id <> i.item_id AND (abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p))
), n AS (
  SELECT r, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM j GROUP BY r
), k AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS rank FROM j QUALIFY rank <= 10
)
SELECT item_id, coalesce(rank, 0)::INT AS rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN n USING (r) LEFT JOIN k USING (r)
"""
