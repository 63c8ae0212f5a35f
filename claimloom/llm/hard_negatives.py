"""Hard-negative mining: product quantisation with residual norms bounds every score, exact integer scores decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, stage

#: Components a subspace (more, where there would be over MOST_PARTS), its centroids, rows they are fitted on, rounds.
PART, MOST_PARTS, CENTROIDS, SAMPLE, ROUNDS = 2, 64, 256, 4096, 8
#: Rows of a block, anchors that meet it in one task, and how many of them at a time.
BLOCK, ASKS, TILE = 32768, 4096, 64
#: Vectors are integers of at most this squared length, so that every score is a long.
LONGEST = 1 << 62


def integers(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


class Quantiser:
    """A codebook for each PART components, of integer centroids, fitted by k-means on a sample."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 3):
        rng, self.books = np.random.default_rng(seed), []
        self.part = max(PART, -(-sample.shape[1] // MOST_PARTS))
        for at in range(0, sample.shape[1], self.part):
            x = np.unique(sample[:, at : at + self.part], axis=0).astype(np.float64)
            c = x[np.sort(rng.permutation(len(x))[:centroids])]
            for _ in range(rounds if len(x) > len(c) else 0):
                near = self.closest(x, c)
                n = np.bincount(near, minlength=len(c))
                sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
                c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            self.books.append(np.rint(c).astype(np.int64))

    @staticmethod
    def closest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.float64)
        return np.concatenate([((c * c).sum(1) - 2 * x[a : a + 4096] @ c.T).argmin(1) for a in range(0, len(x), 4096)] or [np.zeros(0, int)])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x subspaces) and the residuals' norms, with a margin for what sums in doubles may round."""
        codes, rest = np.empty((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, c in enumerate(self.books):
            part = x[:, m * self.part : (m + 1) * self.part]
            codes[:, m] = self.closest(part.astype(np.float64), c)
            rest += ((part - c[codes[:, m]]).astype(np.float64) ** 2).sum(1)
        rest = np.sqrt(rest)
        return codes, rest + 1e-9 + 1e-12 * (rest + length(x))

    def scores(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Scores (rows x queries) of the quantised rows: sums over tables of each subspace's centroids by query."""
        out = np.zeros((len(codes), len(q)))
        for m, c in enumerate(self.books):
            out += (c.astype(np.float64) @ q[:, m * self.part : (m + 1) * self.part].T.astype(np.float64))[codes[:, m]]
        return out


def length(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(1))


def best(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Where, going by bounds alone, one of the k largest may be."""
    if len(low) <= k:
        return np.arange(len(low))
    return np.flatnonzero(high >= np.partition(low, len(low) - k)[len(low) - k])


def first(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows, ids, -score))[:k]


def mine(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, vec_id: str = "vec_id", vector: str = "v", label: str = "label", block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows(vec_id, label, integer vector).

    A score is the integer inner product with the anchor; higher ones come first, ties by smaller vec_id. An anchor's
    positives are its first other rows of its label; its negatives for a positive are the first rows of another label with
    low * positive_score <= 100 * score <= high * positive_score. Rows with a null vec_id, label, vector or component, an
    empty vector, or a squared length over 2**62 take no part. Repeated rows each count. Only vectors of one length meet.
    Rows lie in blocks with their codes and residual norms; anchors meet every block twice, ASKS at a time: rows of their
    label for positives, the others for negatives. Scores of the codes, summed from tables, plus or minus query norm times
    residual norm bound the true ones, so that what is left out cannot be among the first; the rest is scored exactly. A
    block sends on its own first rows only. The codebooks are broadcast; they are fitted on SAMPLE rows and change no result.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    v = F.col(vector)
    all_rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"), v.cast("array<long>").alias("v"), is_anchor.alias("anchor"))
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()) & (size <= float(LONGEST) * (1 - 1e-12))
    valid = stage(all_rows.where(F.coalesce(fine, F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    dims = [r.d for r in valid.groupBy(F.size("v").alias("d")).agg(F.count_if("anchor").alias("n")).where("n > 0").orderBy("d").collect()]
    for k, dim in enumerate(dims):
        one = _mine(valid.where(F.size("v") == dim), positives, negatives, low, high, block)
        out = one if k == 0 else out.union(one)
    return out


def _mine(valid: DataFrame, positives: int, negatives: int, low: int, high: int, block: int) -> DataFrame:
    """mine(...) among valid(id, label, v, anchor, row), whose vectors all have one length."""
    spark = valid.sparkSession
    sample = valid.select(F.xxhash64("id", "row").alias("draw"), "v").orderBy("draw").limit(SAMPLE).select("v").toArrow()
    held = spark.sparkContext.broadcast(Quantiser(integers(sample.column("v").combine_chunks())))
    n = valid.agg(F.count("*"), F.count_if("anchor")).first()
    blocks, groups = -(-n[0] // block), -(-n[1] // ASKS)

    def encode(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, norms = held.value.encode(integers(b.column("v")))
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "row", "label", "v")), packed, pa.array(norms)], ["id", "row", "label", "v", "codes", "norm"])

    fields = "id long, row long, label int, v array<long>, codes binary, norm double"
    coded = stage(valid.select("id", "row", "label", "v").mapInArrow(encode, fields), "coded")
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    right = coded.select("*", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), numbers(groups).alias("group")).groupBy("block", "group")

    def asks(anchors: DataFrame):
        return anchors.select("*", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"), numbers(blocks).alias("block")).groupBy("block", "group")

    def same_label(_, left: pa.Table, table: pa.Table) -> pa.Table:
        found = []
        for at, q, mine in _met(left, table, held.value):
            pick = np.flatnonzero((mine.label == at["label"]) & (mine.row != at["row"]))
            pick = pick[best(mine.low[pick], mine.high[pick], positives)]
            score = mine.v[pick] @ q
            for j in first(score, mine.id[pick], mine.row[pick], positives):
                found.append((at["row"], mine.id[pick[j]], mine.row[pick[j]], score[j]))
        return _table(found, ("anchor", "id", "row", "score"))

    anchors = valid.where("anchor").select("id", "row", "label", "v")
    own = asks(anchors).cogroup(right).applyInArrow(same_label, "anchor long, id long, row long, score long")
    own = own.withColumn("at", F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id", "row"))).where(F.col("at") <= positives)
    own = stage(own.select("anchor", "at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def other_labels(_, left: pa.Table, table: pa.Table) -> pa.Table:
        found = []
        for at, q, mine in _met(left, table, held.value):
            other = mine.label != at["label"]
            for which, ps in at["windows"]:
                least, most = -(-low * ps // 100), high * ps // 100
                if least > most:
                    continue
                pick = np.flatnonzero(other & (mine.low <= most) & (mine.high >= least))
                sure = mine.low[pick[mine.high[pick] <= most]]
                if len(sure) > negatives:
                    pick = pick[mine.high[pick] >= np.partition(sure, len(sure) - negatives)[len(sure) - negatives]]
                score = mine.v[pick] @ q
                fit = (score >= least) & (score <= most)
                pick, score = pick[fit], score[fit]
                for j in first(score, mine.id[pick], mine.row[pick], negatives):
                    found.append((at["row"], which, mine.id[pick[j]], mine.row[pick[j]], score[j]))
        return _table(found, ("anchor", "at", "id", "row", "score"))

    windows = own.groupBy("anchor").agg(F.collect_list(F.struct("at", "positive_score")).alias("windows"))
    asking = anchors.join(windows, F.col("row") == F.col("anchor")).drop("anchor")
    met = asks(asking).cogroup(right).applyInArrow(other_labels, "anchor long, at long, id long, row long, score long")
    met = met.withColumn("rank", F.row_number().over(W.partitionBy("anchor", "at").orderBy(F.desc("score"), "id", "row"))).where(F.col("rank") <= negatives)
    out = met.withColumn("at", F.col("at").cast("int")).join(own, ["anchor", "at"]).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


class _Rows:
    """A block's rows, and for one anchor at a time the bounds of their scores."""

    def __init__(self, table: pa.Table):
        self.id, self.row, self.label, self.norm = (table.column(c).to_numpy() for c in ("id", "row", "label", "norm"))
        self.v = integers(table.column("v").combine_chunks())
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(self.id), -1)
        self.low = self.high = np.zeros(0)


def _met(left: pa.Table, table: pa.Table, quantiser: Quantiser) -> Iterator[tuple[dict, np.ndarray, _Rows]]:
    """Each anchor of `left` with its vector and the block's rows, bounds set for it."""
    if not left.num_rows or not table.num_rows:
        return
    mine, q = _Rows(table), integers(left.column("v").combine_chunks())
    norms = length(q) * (1 + 1e-12)
    asks = left.select([c for c in left.column_names if c in ("row", "label", "windows")]).to_pylist()
    for a in range(0, len(q), TILE):
        scores = np.ascontiguousarray(quantiser.scores(q[a : a + TILE], mine.codes).T)
        for i, score in enumerate(scores):
            mine.low, mine.high = score - mine.norm * norms[a + i], score + mine.norm * norms[a + i]
            ask = asks[a + i]
            if "windows" in ask:
                ask["windows"] = [(w["at"], w["positive_score"]) for w in ask["windows"]]
            yield ask, q[a + i], mine


def _table(found: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({c: pa.array([int(r[j]) for r in found], pa.int64()) for j, c in enumerate(names)})


def op11(spark, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over whole `embeddings`, anchors being the
    rows whose vec_id is divisible by 100; where it is divisible by 7, the label is first made another."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(LONGEST)))
    v = F.when(fine, F.transform(x, lambda c: F.floor(c * 256)))
    return mine(rows.select("vec_id", label.alias("label"), v.alias("v")), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


OP11_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
