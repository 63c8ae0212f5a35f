"""A corpus from documents to token ids: language, near-duplicates, secrets, mixture, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import language_id as languages
from claimloom.llm import mixing, near_dedup, secret_scan, tokens
from claimloom.llm.common import stage

CORE = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL expresses the first, third and fifth stage; tests compare each stage with a plain version.
ORACLE_SQL = None


def guarded(function):
    """A stage whose documents may have other columns, of any name: they pass under names that no operator uses."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = [c if c in CORE else f"_other{k}" for k, c in enumerate(docs.columns)]
        out = function(spark, docs.toDF(*names), sf_dir)
        return out.select(*names).toDF(*docs.columns)

    return run


@guarded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; those without any letter (`und`) go. A null lang is filled in."""
    langs, probs = languages.train(docs)
    out = languages.identify(docs, langs, probs).where(F.col("lang_pred") != languages.UND)
    return out.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


@guarded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Rows are told apart by doc_id; where ids repeat or are null, the documents are written out with a row number first.
    """
    groups = stage(near_dedup.near_duplicates(docs).select("doc_id", "kept"), "groups")
    if groups.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        kept, key = groups.where("kept").select("doc_id"), "doc_id"
    else:
        docs, key = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"), "_row"
        kept = stage(near_dedup.near_duplicates(docs, row_id="_row").where("first").select("_row"), "firsts")
    right = F.broadcast(kept) if kept.count() <= near_dedup.BROADCAST_IDS else kept
    return docs.join(right, key, "left_semi").drop("_row")


@guarded
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every found secret replaced in the text."""
    return secret_scan.redact(secret_scan.judged(docs)).select(docs.columns)


@guarded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate says."""
    return mixing.emit(mixing.mix(docs)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digests of the ids and of the decoded text."""
    return tokens.round_trip(docs.select("doc_id", "lang", "source", "text"), tokens.vocabulary(), with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("source mixing", mix_sources),
    ("BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"stage{k}")
    return docs
