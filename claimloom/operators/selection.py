"""Dedupe, caps, floors and rankings within a claim, as windows over an explicit position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_key, text_key
from ..functions.urls import canonical_url, host


def evidence_key(n: int, url: str = "url", text: str = "text") -> Column:
    """The canonical URL, or the first n characters of the folded text; null if both are empty."""
    u, t = canonical_url(url), text_key(text, n)
    return F.when(u != "", u).when(t != "", t)


def scored_key(url: str = "url", title: str = "title", text: str = "text") -> Column:
    u, h, t = canonical_url(url), F.substring(norm_key(title), 1, 180), text_key(text, 220)
    return F.when(u != "", u).when(h != "", h).when(t != "", t)


def pair_key(n: int, url: str = "url", text: str = "text") -> Column:
    """URL and text head together."""
    return F.concat_ws("\u0001", F.lower(F.coalesce(url, F.lit(""))), text_key(text, n))


def first_per_key(rows: DataFrame, by: list[str], key: Column, order: list, keep_empty: bool = False) -> DataFrame:
    """The first row of each (by, key) in `order`; rows with a null key go, or with keep_empty are one key."""
    r = rows.withColumn("_key", F.coalesce(key, F.lit("")) if keep_empty else key)
    if not keep_empty:
        r = r.where(F.col("_key").isNotNull())
    return r.withColumn("_n", F.row_number().over(W.partitionBy(*by, "_key").orderBy(*order))).where("_n = 1").drop("_n", "_key")


def best_per_key(rows: DataFrame, by: list[str], key: Column, score: str, pos: str) -> DataFrame:
    """The row of the highest score of each key (the first of equals), at the place of the key's first row: pos."""
    w = W.partitionBy(*by, "_key")
    r = rows.withColumn("_key", key).where(F.col("_key").isNotNull())
    r = r.withColumn("_n", F.row_number().over(w.orderBy(F.desc(score), pos))).withColumn("_first", F.min(pos).over(w))
    return r.where("_n = 1").withColumn(pos, F.col("_first")).drop("_n", "_first", "_key")


def cap_per(rows: DataFrame, by: list[str], group: Column, most: int, order: list) -> DataFrame:
    """At most `most` rows of each group in `order`; rows whose group is null or empty all stay."""
    r = rows.withColumn("_g", F.coalesce(group, F.lit("")))
    n = F.row_number().over(W.partitionBy(*by, "_g").orderBy(*order))
    return r.withColumn("_n", n).where((F.col("_n") <= most) | (F.col("_g") == "")).drop("_n", "_g")


def cap_flagged(rows: DataFrame, by: list[str], flag: Column, most: int, order: list) -> DataFrame:
    """At most `most` flagged rows in `order`; the others all stay. A negative `most` is no cap."""
    if most < 0:
        return rows
    run = F.sum(flag.cast("int")).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_run", run).where(~flag | (F.col("_run") <= most)).drop("_run")


def top(rows: DataFrame, by: list[str], order: list, most: int, rank: str | None = None) -> DataFrame:
    """The first `most` rows of each group in `order`, with their rank if it gets a name."""
    r = rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most)
    return r.withColumnRenamed("_n", rank) if rank else r.drop("_n")


def by_host(rows: DataFrame, by: list[str], most: int, order: list, url: str = "url") -> DataFrame:
    return cap_per(rows, by, host(url), most, order)


def relevance_floor(rows: DataFrame, by: list[str], order: list, relevance: str = "relevance", least: float = 0.30, min_keep: int | Column = 3, key_len: int = 220) -> DataFrame:
    """Rows of enough relevance; where a claim has fewer than min_keep, the next unseen ones by `order` are added; where it
    has none, its first min_keep rows."""
    w = W.partitionBy(*by)
    r = rows.withColumn("_pass", F.col(relevance) >= least).withColumn("_key", evidence_key(key_len))
    r = r.withColumn("_passed", F.sum(F.col("_pass").cast("int")).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(*order)))
    k = W.partitionBy(*by, "_key")
    r = r.withColumn("_seen", F.max(F.col("_pass").cast("int")).over(k)).withColumn("_dup", F.row_number().over(k.orderBy(F.col("_pass").cast("int"), "_rank")))
    can = ~F.col("_pass") & F.col("_key").isNotNull() & (F.col("_seen") == 0) & (F.col("_dup") == 1)
    r = r.withColumn("_add", F.sum(can.cast("int")).over(w.orderBy("_rank").rowsBetween(W.unboundedPreceding, 0)))
    fill = can & (F.col("_add") <= min_keep - F.col("_passed"))
    keep = F.when(F.col("_passed") == 0, F.col("_rank") <= min_keep).otherwise(F.col("_pass") | fill)
    return r.where(keep).drop("_pass", "_key", "_passed", "_rank", "_seen", "_dup", "_add")


def noise_guard(rows: DataFrame, claim_tokens: Column, text_tokens: Column, relevance: str = "relevance", least: float = 0.92) -> DataFrame:
    """Rows that share no token with the claim go unless they are very relevant."""
    return rows.where((F.size(claim_tokens) == 0) | F.arrays_overlap(claim_tokens, text_tokens) | (F.col(relevance) >= least))


def drop_rejected(rows: DataFrame, by: list[str], pos: str, tier: str = "evidence_tier", relevance: str = "relevance", structured: str = "structured", least: float = 0.22) -> DataFrame:
    """Rows that are not rejected, and rejected ones that are structured or fairly relevant after them; the first two where none is left."""
    kept = (F.col(tier) != "reject") | F.col(structured) | (F.col(relevance) >= least)
    w = W.partitionBy(*by)
    r = rows.withColumn("_keep", kept).withColumn("_any", F.max(F.col("_keep").cast("int")).over(w)).withColumn("_n", F.row_number().over(w.orderBy(pos)))
    return r.where(F.col("_keep") | ((F.col("_any") == 0) & (F.col("_n") <= 2))).drop("_keep", "_any", "_n")


def staged_fallback(rows: DataFrame, by: list[str], stage: str, key: Column, enough: int) -> DataFrame:
    """Rows of the stages that would run: a stage runs while the stages before it have fewer than `enough` different keys."""
    r = rows.withColumn("_key", key)
    first = r.groupBy(*by, "_key").agg(F.min(stage).alias("_stage"))
    per = first.groupBy(*by, "_stage").agg(F.count("*").alias("_new"))
    before = F.coalesce(F.sum("_new").over(W.partitionBy(*by).orderBy("_stage").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stages = rows.select(*by, F.col(stage).alias("_stage")).distinct().join(per, [*by, "_stage"], "left").withColumn("_before", before).where(F.col("_before") < enough)
    return rows.join(stages.select(*by, F.col("_stage").alias(stage)), [*by, stage], "left_semi")
