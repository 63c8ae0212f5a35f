"""Canonical exact digests: folded texts under a 128-bit hash, with a byte comparison inside equal buckets."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, set_aside, small_batches, stage

#: Shared buckets whose hashes are broadcast to spare other texts a shuffle; more are joined by a shuffle.
BROADCAST_BUCKETS = 1_000_000


def canonical(text: str) -> str:
    """NFKC, case folding, NFKC again, runs of white space as one space, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(canon: str, bits: int = 128) -> str:
    """The hexadecimal xxh3 hash; its first bits // 4 digits, so that tests can have collisions."""
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))[: bits // 4]


def fingerprint(docs: DataFrame, text: str = "text", bits: int = 128) -> DataFrame:
    """docs with `fingerprint`: equal for two rows exactly if their canonical texts are equal. Null counts as empty.

    Hashes are grouped first; texts are shuffled only for hashes that several rows have, and each task sends every
    different text of such a bucket once. A bucket whose smallest and largest bytes differ is a collision: its texts
    in byte order get -1, -2, ... after the first. A column of docs called fingerprint is replaced, others stay.
    """
    bound_batches(docs.sparkSession)
    keep, called = set_aside(docs, (text,), ("fingerprint",))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema)

    def add(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, text):
            hashes = [digest(canonical(t or ""), bits) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.string())], [*b.schema.names, "fingerprint"])

    def canon(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, text):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([canonical(t or "") for t in b.column(text).to_pylist()], pa.string())], [*b.schema.names, "_canon"])

    hashed = keep.mapInArrow(add, f"{kinds}, fingerprint string")
    clashes = collisions(keep.select(F.col(text).alias("text")), hashed.select("fingerprint"), bits)
    if not clashes.isEmpty():
        hashed = hashed.mapInArrow(canon, f"{kinds}, fingerprint string, _canon string")
        hashed = _ranked(hashed, clashes, "fingerprint", "_canon").select(*keep.columns, "fingerprint")
    return hashed.toDF(*called.values(), "fingerprint")


def collisions(texts: DataFrame, hashes: DataFrame, bits: int = 128) -> DataFrame:
    """(fingerprint, canon, rank) of the texts in buckets that hold different bytes; texts(text), hashes(fingerprint)."""
    shared = stage(hashes.groupBy("fingerprint").count().where("count > 1").select("fingerprint"), "buckets")
    right = F.broadcast(shared) if shared.count() <= BROADCAST_BUCKETS else shared

    def canon(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            different = {(digest(c, bits), c) for t in b.column("text").to_pylist() for c in [canonical(t or "")]}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in different], pa.string()), pa.array([x[1] for x in different], pa.string())], ["fingerprint", "canon"])

    rows = texts.select("text").mapInArrow(canon, "fingerprint string, canon string").join(right, "fingerprint", "left_semi")
    return _ranks(rows)


def _ranks(rows: DataFrame) -> DataFrame:
    """(fingerprint, canon, rank) of the different texts, in byte order, of buckets of rows(fingerprint, canon) that hold several."""
    ends = rows.groupBy("fingerprint").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi")
    clash = stage(ends.select("fingerprint"), "clashes")
    if clash.isEmpty():
        return rows.sparkSession.createDataFrame([], "fingerprint string, canon string, rank int")
    every = rows.select("fingerprint", "canon").join(clash, "fingerprint", "left_semi").distinct()
    return stage(every.withColumn("rank", F.row_number().over(W.partitionBy("fingerprint").orderBy("canon")) - 1), "ranks")


def _ranked(rows: DataFrame, ranks: DataFrame, hashed: str, canon: str) -> DataFrame:
    """rows whose fingerprint in column `hashed` has its text's rank in a bucket with a collision, the first none."""
    r = ranks.select(F.col("fingerprint").alias("_f"), F.col("canon").alias("_c"), F.col("rank").alias("_rank"))
    got = rows.join(r, (F.col(hashed) == F.col("_f")) & (F.col(canon) == F.col("_c")), "left")
    return got.withColumn(hashed, F.when(F.col("_rank") > 0, F.concat_ws("-", hashed, "_rank")).otherwise(F.col(hashed))).drop("_f", "_c", "_rank")


def _check(canon: str) -> int:
    """A second hash, of another seed: texts that share a fingerprint and not this one differ."""
    return xxhash.xxh3_64_intdigest(canon.encode("utf-8", "surrogatepass"), seed=0x5EED) - (1 << 63)


def _compare(doc: int | None, text: str, after: str, bits: int, with_canon: bool) -> tuple:
    """What a document's row says of it, of its edited text and of the next document."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    own, cut, other = canonical(text), canonical(edited), canonical(after)
    row = doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(own, bits), digest(cut, bits), float(cut == own), float(other == own), _check(own), _check(cut)
    return (*row, own, cut) if with_canon else (*row, None, None)


_FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, check long, edited_check long, canon string, edited_canon string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("check", pa.int64()), ("edited_check", pa.int64()), ("canon", pa.string()), ("edited_canon", pa.string())])
_ENDS = (0, "", "", "", 0.0, 0.0, 0, 0, None, None)


def edited_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 128, with_canon: bool = False) -> DataFrame:
    """_FIELDS, the canonical texts with_canon only: a row for each row of docs in ascending doc_id order (null last, ties by text), compared with its edited text and
    with the next row; after the last comes the first.

    Rows are range-partitioned and sorted once. A partition's last row meets the first row of the next partition that
    has any: two rows for each partition, joined by the partition's number.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def scan(batches) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def out(rows: list[tuple], kind: int, texts: list) -> pa.RecordBatch:
            cols = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([kind] * len(rows), pa.int32()), *cols, pa.array(texts, pa.string())], ["part", "kind", *_SCHEMA.names, "text"])

        for b in small_batches(batches, "text"):
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                t = t or ""
                if last is None:
                    yield out([(d, *_ENDS)], 1, [t])
                else:
                    rows.append(_compare(*last, t, bits, with_canon))
                last = (d, t)
            if rows:
                yield out(rows, 0, [None] * len(rows))
        if last is not None:
            yield out([(last[0], *_ENDS)], 2, [last[1]])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    got = stage(rows.repartitionByRange(n, order[0]).sortWithinPartitions(*order).mapInArrow(scan, f"part int, kind int, {_FIELDS}, text string"), "pairs")
    parts = sorted(r.part for r in got.where("kind = 1").select("part").collect())
    if not parts:
        return got.drop("part", "kind", "text")
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, then int")
    firsts = got.where("kind = 1").select(F.col("part").alias("then"), F.col("text").alias("after"))
    edges = got.where("kind = 2").select("part", "doc_id", "text").join(follow, "part").join(firsts, "then").select("doc_id", "text", "after")

    def close(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            rows = [_compare(*x, bits, with_canon) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    return got.where("kind = 0").drop("part", "kind", "text").union(edges.mapInArrow(close, _FIELDS))


def compared(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 128) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    Likeness of exact digests is 1 for equal canonical texts and else 0. Two fingerprints, of texts or of edited texts, are
    equal only for equal canonical texts: texts of one bucket are compared by their bytes and edited texts by a second
    hash; if that finds a collision, the texts of all such buckets are ranked and the rank is added, row by row.
    """
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    pairs = stage(edited_pairs(docs, text, doc_id, bits), "edited")
    both = pairs.select("fingerprint", "check").union(pairs.where("near_edited = 0").select("edited_fingerprint", "edited_check"))
    unlike = both.groupBy("fingerprint").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
    if unlike.isEmpty() and collisions(docs.select(F.col(text).alias("text")), pairs.select("fingerprint"), bits).isEmpty():
        return pairs.select(*out)
    full = stage(edited_pairs(docs, text, doc_id, bits, with_canon=True), "canons")
    ranks = _ranks(full.select("fingerprint", "canon").union(full.select("edited_fingerprint", "edited_canon")))
    return _ranked(_ranked(full, ranks, "fingerprint", "canon"), ranks, "edited_fingerprint", "edited_canon").select(*out)


def op9(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of documents."""
    return compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
