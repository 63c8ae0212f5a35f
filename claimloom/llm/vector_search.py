"""Approximate nearest neighbours over several shifted Hilbert orderings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, stage

CURVES, AXES, BITS = 4, 8, 7
BLOCK = 4096
SAMPLE = 64
#: Queries that meet a block of points in one task at a time.
ASKS = 2048


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n x axes), bits an axis (Skilling's transform), as int64."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def axes_of(dim: int, curves: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each curve an orthonormal projection to at most AXES axes and a shift of up to a quarter of the range."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(curves):
        q, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        out.append((q[:, : min(AXES, dim)], rng.uniform(-0.25, 0.25, min(AXES, dim))))
    return out


def keys(v: np.ndarray, mean: np.ndarray, scale: float, axes: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    return [hilbert(np.clip(((v - mean) @ p / (8 * scale) + 0.5 + s) * (1 << BITS), 0, (1 << BITS) - 1)) for p, s in axes]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x from q in double precision, from the differences."""
    return np.sqrt(((x - q) ** 2).sum(1))


def nearest(x: np.ndarray, q: np.ndarray, k: int, within: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of q the row numbers and distances of its k nearest rows of x, ties with the k-th included.

    Products find what can be among them; distances are those of `distances`. within[i] limits q[i] to some rows."""
    out, xx, qq = [], (x * x).sum(1), (q * q).sum(1)
    for a in range(0, len(q), 256):
        d = xx[None] + qq[a : a + 256, None] - 2 * q[a : a + 256] @ x.T
        for i in range(len(d)):
            row = d[i]
            if within is not None:
                lo, hi = within[a + i]
                row = row[lo:hi]
            else:
                lo = 0
            if len(row) > k:
                bound = np.partition(row, k - 1)[k - 1]
                at = np.flatnonzero(row <= bound + 1e-9 * (1 + abs(bound) + qq[a + i])) + lo
            else:
                at = np.arange(len(row)) + lo
            out.append((at, distances(x[at], q[a + i])))
    return out


def vectors(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null, empty nor zero and has only finite components."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def search(rows: DataFrame, is_query, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", curves: int = CURVES, target: float = 0.975, least_window: int = 1024, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of the other rows for each row for which is_query holds.

    Equal vectors are searched once and stand for their k + 1 smallest ids, so that ties go to the smaller vec_id and a
    vector that a third of the rows share is one point. Points are ordered along `curves` Hilbert curves over shifted
    projections, range-partitioned by curve and key; a query meets the points in a window around its place on each
    curve, and the k nearest by true distance over all curves stay. The window is the smallest (from least_window) that
    finds a share `target` of the true neighbours of `sample` query points, searched exhaustively: vectors without
    structure get windows of much of the table, up to all of it. A block of points meets its queries in groups of about
    ASKS, so that no task holds more than a group and a block. Rows with null ids, null vectors, null or non-finite
    components, or only zeros take no part. Vectors of different lengths have no distance: each length is searched by
    itself. The vectors of the sample, one offset for each partition and curve, and the means are all that is broadcast.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    all_rows = usable(rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("query")).where(F.col("id").isNotNull()), "v")
    valid = stage(all_rows.withColumn("row", F.monotonically_increasing_id()).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "vectors")
    dims = [r.d for r in valid.groupBy(F.size("v").alias("d")).agg(F.count_if("query").alias("n")).where("n > 0").orderBy("d").collect()]
    for k_dim, dim in enumerate(dims):
        one = _search(valid if len(dims) == 1 else valid.where(F.size("v") == dim), dim, k, curves, target, least_window, sample)
        out = one if k_dim == 0 else out.union(one)
    return out


def _search(valid: DataFrame, dim: int, k: int, curves: int, target: float, least_window: int, sample: int) -> DataFrame:
    """search(...) among valid(id, v, query, row), whose vectors all have dim components."""
    spark = valid.sparkSession
    valid = valid.where(F.size("v") == dim)
    ranked = valid.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id", "row"))).where(F.col("n") <= k + 1)
    queries = valid.where("query").select("v").distinct().withColumn("asked", F.lit(True))
    points = ranked.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("rows")).join(queries, "v", "left")
    points = stage(points.select(F.monotonically_increasing_id().alias("point"), F.col("rows")[0]["id"].alias("low"), F.coalesce("asked", F.lit(False)).alias("asked"), "v", "rows"), "points")

    def moments(batches) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dim), 0.0
        for b in batches:
            x = vectors(b.column("v"))
            n, s, ss = n + len(x), s + (x.sum(0) if len(x) else 0), ss + float((x**2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([ss])], ["n", "s", "ss"])

    got = points.select("v").mapInArrow(moments, "n long, s array<double>, ss double").where("n > 0")
    sums = got.select("n", "ss", F.posexplode("s")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"), F.sum("ss").alias("ss")).orderBy("pos").collect()
    mean = np.array([r.s / r.n for r in sums])
    scale = max(1e-300, float(max(0.0, sums[0].ss / sums[0].n - (mean**2).sum()) / dim) ** 0.5)
    axes = axes_of(dim, curves)

    def place(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, key in enumerate(keys(vectors(b.column("v")), mean, scale, axes)):
                yield pa.RecordBatch.from_arrays([pa.array([c] * b.num_rows, pa.int32()), pa.array(key), b.column("point"), b.column("low"), b.column("asked"), b.column("v")], ["curve", "key", "point", "low", "asked", "v"])

    fields = "point long, low long, asked boolean, v array<double>"
    curve_rows = points.select("point", "low", "asked", "v").mapInArrow(place, f"curve int, key long, {fields}")

    def number(batches) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            at = []
            for c in b.column("curve").to_pylist():
                seen[c] = seen.get(c, -1) + 1
                at.append(seen[c])
            yield pa.RecordBatch.from_arrays([b.column("curve"), pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64()), *(b.column(c) for c in ("point", "low", "asked", "v"))], ["curve", "part", "at", "point", "low", "asked", "v"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = curve_rows.repartitionByRange(n, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
    ordered = stage(ordered.mapInArrow(number, f"curve int, part int, at long, {fields}"), "curves")
    offsets, seen = [], {}
    for r in sorted(ordered.groupBy("curve", "part").count().collect(), key=lambda r: (r.curve, r.part)):
        offsets.append((r.curve, r.part, seen.get(r.curve, 0)))
        seen[r.curve] = seen.get(r.curve, 0) + r["count"]
    starts = spark.createDataFrame(offsets, "curve int, part int, start long")
    placed = ordered.join(F.broadcast(starts), ["curve", "part"]).withColumn("place", F.col("start") + F.col("at")).drop("part", "at", "start")
    window = max(least_window, _window(points, placed, k, target, sample))

    block = lambda c: F.floor(c / BLOCK)
    asked = points.where("asked").count()
    groups = max(1, -(-asked * min(2 * window + BLOCK, max(seen.values(), default=1)) // (max(seen.values(), default=1) * ASKS)))
    right = placed.select("curve", block(F.col("place")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(int(groups) - 1))).alias("group"), "place", "point", "low", "v")
    last = F.lit(max(seen.values(), default=1) - 1)
    asks = placed.where("asked").select(F.col("curve").alias("q_curve"), F.col("place").alias("q_place"), F.col("point").alias("ask"), F.pmod(F.xxhash64("point"), F.lit(int(groups))).cast("int").alias("q_group"), F.col("v").alias("q_v"), F.explode(F.sequence(block(F.greatest(F.col("place") - window, F.lit(0))), block(F.least(F.col("place") + window, last)))).alias("q_block"))

    def meet(key, left: pa.Table, table: pa.Table) -> pa.Table:
        if not left.num_rows or not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("ask", pa.int64()), ("point", pa.int64()), ("low", pa.int64()), ("score", pa.float64()))})
        place = table.column("place").to_numpy()
        order = np.argsort(place)
        place, x = place[order], vectors(table.column("v").combine_chunks())[order]
        point, low = table.column("point").to_numpy()[order], table.column("low").to_numpy()[order]
        mine = left.column("q_place").to_numpy()
        bounds = np.stack([np.searchsorted(place, mine - window), np.searchsorted(place, mine + window, side="right")], 1)
        asked, rows = left.column("ask").to_numpy(), []
        for i, (at, d) in enumerate(nearest(x, vectors(left.column("q_v").combine_chunks()), k + 1, bounds)):
            keep = np.lexsort((low[at], d))[: k + 1]
            rows.append((np.full(len(keep), asked[i]), point[at[keep]], low[at[keep]], d[keep]))
        return pa.table({c: np.concatenate([r[j] for r in rows]) for j, c in enumerate(("ask", "point", "low", "score"))})

    met = asks.groupBy("q_curve", "q_block", "q_group").cogroup(right.groupBy("curve", "block", "group")).applyInArrow(meet, "ask long, point long, low long, score double")
    best = met.dropDuplicates(["ask", "point"]).withColumn("n", F.row_number().over(W.partitionBy("ask").orderBy("score", "low", "point"))).where(F.col("n") <= k + 1)
    best = stage(best.select("ask", "point", "score"), "best")
    found = best.join(points.select("point", "rows"), "point").select("ask", "score", F.explode("rows").alias("r")).withColumn("n", F.row_number().over(W.partitionBy("ask").orderBy("score", "r.id", "r.row"))).where(F.col("n") <= k + 1)
    near = found.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("score", F.col("r.id").alias("id"), F.col("r.row").alias("row")))).alias("near"))
    near = near.join(points.where("asked").select(F.col("point").alias("ask"), F.col("v").alias("of")), "ask")
    ask = valid.where("query").select(F.col("id").alias("query_id"), F.col("row").alias("own"), "v").join(near, F.col("v") == F.col("of"))
    out = ask.select("query_id", F.posexplode(F.slice(F.filter("near", lambda r: r["row"] != F.col("own")), 1, k)).alias("pos", "r"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("r.id").alias("vec_id"), F.col("r.score").alias("score"))


def _window(points: DataFrame, placed: DataFrame, k: int, target: float, sample: int) -> int:
    """The window within which, on the best curve for each, a share `target` of the sample's true neighbours lie."""
    spark = points.sparkSession
    some = points.where("asked").orderBy(F.xxhash64("point"), "point").limit(sample).select("point", "v").toArrow()
    if not some.num_rows:
        return 0
    held = spark.sparkContext.broadcast((some.column("point").to_numpy(), vectors(some.column("v").combine_chunks())))

    def exact(batches) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        for b in batches:
            point = b.column("point").to_numpy()
            for i, (at, d) in enumerate(nearest(vectors(b.column("v")), q, k + 1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ids[i])), pa.array(point[at]), pa.array(d)], ["ask", "point", "score"])

    true = points.select("point", "v").mapInArrow(exact, "ask long, point long, score double").where("ask <> point")
    true = true.withColumn("n", F.row_number().over(W.partitionBy("ask").orderBy("score", "point"))).where(F.col("n") <= k).select("ask", "point").collect()
    ids = sorted({x for r in true for x in (r.ask, r.point)})
    where = {(r.point, r.curve): r.place for r in placed.join(F.broadcast(spark.createDataFrame([(x,) for x in ids], "point long")), "point").select("point", "curve", "place").collect()} if ids else {}
    curves = {c for _, c in where}
    gaps = sorted(min(abs(where[r.ask, c] - where[r.point, c]) for c in curves) for r in true)
    return int(gaps[min(len(gaps) - 1, int(np.ceil(target * len(gaps))) - 1)]) + 1 if gaps else 0


def op10(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 10 nearest for every row of embeddings whose vec_id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, F.col("vec_id") % 100 == 0)
