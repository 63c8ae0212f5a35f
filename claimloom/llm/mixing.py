"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import set_aside, stage

#: Sources whose targets are broadcast.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, key: str, cycle: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """sizes(key, source_size) with weight and target, targets summing to all sizes.

    Keys by code point, null last, weigh cycle[0], cycle[1], ... repeating. A target stops at cap times its source's
    size and the excess is shared again by weight, until none is above: that is target = min(cap * size, level * weight)
    with one level, which a running sum over sources by cap * size / weight finds. One row per source, so the windows
    without partitions hold as many rows as there are sources, never documents.
    """
    in_order = W.orderBy(F.col(key).asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(x) for x in cycle]), ((F.row_number().over(in_order) - 1) % len(cycle) + 1).cast("int"))
    s = sizes.withColumn("weight", pick.cast("long")).withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col(key).asc_nulls_last())
    before, all_rows = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    capped, weighed = F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) - capped) / (F.sum("weight").over(all_rows) - weighed))
    s = s.withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(all_rows))
    return s.withColumn("target", F.least(F.col("source_size") * F.lit(float(cap)), F.col("level") * F.col("weight"))).drop("ratio", "level")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17, cycle: tuple[int, ...] = (5, 2, 1), cap: int = 3, keep_text: bool = True) -> DataFrame:
    """docs with size, source_size, target, rate and copies: floor(rate) plus one with probability rate - floor(rate).

    The draw is the first 52 bits of md5(seed:doc_id:size), so reruns agree and repeated rows share a draw. A null
    text has size 0; null sources are one source; a source of size 0 has target and rate 0. Columns of docs with the
    names of new ones are replaced, others of any name stay. Only per-source totals are shuffled: one row for each source and task. The table of
    targets is written out and broadcast back if it has at most BROADCAST_SOURCES rows, so that texts stay where they
    are and a source may hold any share of them; with more sources than that it is joined by a shuffle.
    """
    new = ["size", "source_size", "target", "rate", "copies"]
    docs, called = set_aside(docs, (text, source, doc_id), new)
    out = [c for c in docs.columns if keep_text or c != text]
    d = docs.withColumn("size", n_words(text))
    if not keep_text:
        d = d.drop(text)
    sums = docs.select(F.col(source), n_words(text).alias("size")).groupBy(source).agg(F.sum("size").alias("source_size"))
    t = stage(targets(sums, source, cycle, cap).select(F.col(source).alias("_source"), "source_size", "target"), "targets")
    d = d.join(F.broadcast(t) if t.count() <= BROADCAST_SOURCES else t, d[source].eqNullSafe(t["_source"]), "left").drop("_source")
    d = d.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col("size").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    d = d.withColumn("copies", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int"))
    return d.select(*out, *new).toDF(*(called[c] for c in out), *new)


def emit(mixed: DataFrame, copy: str = "copy") -> DataFrame:
    """Every row as often as copies says, numbered from 1 in `copy`."""
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies"))))


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of documents; copies follows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    m = mix(docs, keep_text=False)
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), r AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS ratio FROM w
), lv AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * (SELECT level FROM lv WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target FROM lv
), m AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM m
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
