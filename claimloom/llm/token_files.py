"""Token-id files: canonical length-limited Huffman codes from global counts, independent blocks, table-driven decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, list_array, small_batches, stage, stage_path, unstage
from .tokens import Bpe, map_ids, vocabulary

LONGEST = 16
BLOCK_IDS = 1 << 16
STEP = 64
#: Bytes of a text beyond which several tasks encode it; below, dealing out its leaves costs more than it spares.
LONG_TEXT = 1 << 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; 0 where the count is 0.

    At every level the cheapest items are a prefix of the sorted leaves and a prefix of the packages, so that only the
    order of leaves and packages is kept for each level.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols do not fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    items, levels = leaves, [np.ones(len(leaves), dtype=bool)]
    for _ in range(longest - 1):
        even = len(items) // 2 * 2
        both = np.concatenate([leaves, items[0:even:2] + items[1:even:2]])
        at = np.argsort(both, kind="stable")
        items = both[at]
        levels.append(at < len(leaves))
    take = 2 * (len(leaves) - 1)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        out[order[:n]] += 1
        take = 2 * (take - n)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then by id, as integers of that many bits."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = last = 0
    for k in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[k])
        if n:
            code <<= n - last
            codes[k], last = code, n
            code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids, most significant bit first, and the bit offset of every STEP-th id, in 64 bits where 32 don't hold them."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    at = end - n
    if not len(ids):
        return b"", np.zeros(0, dtype=np.uint32)
    c, word = codes[ids], at >> 6
    over = (at & 63) + n - 64
    fits = over <= 0
    part = np.where(fits, c << np.where(fits, -over, 0).astype(np.uint64), c >> np.where(fits, 0, over).astype(np.uint64))
    words = np.zeros((int(end[-1]) >> 6) + 2, dtype=np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] = np.bitwise_or.reduceat(part, first)
    cross = np.flatnonzero(~fits)
    words[word[cross] + 1] |= c[cross] << (64 - over[cross]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8], at[::STEP].astype(np.uint32 if int(end[-1]) < 1 << 32 else np.uint64)


def bits_for(n: int) -> int:
    """The length limit for n different ids: LONGEST, or what they need if they are more than that many bits can tell apart."""
    return max(LONGEST, (n - 1).bit_length() if n else 0)


def decode_table(lengths: np.ndarray, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every value of the next `longest` bits (the longest code's, if not given, but LONGEST at least) the id they begin
    with and its length."""
    longest = longest or max(LONGEST, int(lengths.max(initial=0)))
    codes = canonical(lengths)
    symbol, size = np.zeros(1 << longest, dtype=np.uint32), np.ones(1 << longest, dtype=np.uint8)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spread = 1 << (longest - lengths[used].astype(np.int64))
    n = int(spread.sum())
    symbol[:n], size[:n] = np.repeat(used, spread), np.repeat(lengths[used], spread)
    assert not len(used) or int(codes[used[-1]]) < 1 << int(lengths[used[-1]])
    return symbol, size


def unpack(payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of all blocks, one after another. Runs of STEP ids between checkpoints are decoded side by side."""
    symbol, size = table
    longest = len(symbol).bit_length() - 1
    base = np.cumsum([0, *(len(p) for p in payloads)])[:-1]
    buf = np.frombuffer(b"".join(payloads) + bytes(2 * STEP + 8), dtype=np.uint8).astype(np.uint32)
    four = (buf[:-3] << 24) | (buf[1:-2] << 16) | (buf[2:-1] << 8) | buf[3:]
    at = np.concatenate([c.astype(np.int64) + 8 * b for c, b in zip(checkpoints, base, strict=True)]) if payloads else np.zeros(0, np.int64)
    out = np.empty((len(at), STEP), dtype=np.uint32)
    last, mask = len(four) - 1, (1 << longest) - 1
    for k in range(STEP):
        look = (four[np.minimum(at >> 3, last)] >> (32 - longest - (at & 7)).astype(np.uint32)) & mask
        out[:, k] = symbol[look]
        at += size[look]
    left = np.concatenate([np.minimum(STEP, n - np.arange(0, n, STEP)) for n in sizes]) if sizes else np.zeros(0, np.int64)
    return out[np.arange(STEP) < left[:, None]]


def token_rows(docs: DataFrame, vocab: str, end_id: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n, ids): ids with end_id at the end, as little-endian uint32, or uint16 (wide false) where they fit."""

    def make(codec: Bpe, got: list[np.ndarray], joins: list[int]) -> list[pa.Array]:
        kind = "<u2" if max(len(codec.names), end_id + 1) <= 1 << 16 else "<u4"
        tail = np.array([end_id], dtype=kind).tobytes()
        return [pa.array([len(x) + 1 for x in got], pa.int64()), pa.array([x.astype(kind).tobytes() + tail for x in got], pa.binary())]

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_ids(rows, vocab, "text", ["doc_id"], "n long, ids binary", make, over=LONG_TEXT)


def _flat(raw: list[bytes], n: int) -> np.ndarray:
    data = b"".join(raw)
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else "<u4")


def write(docs: DataFrame, path: str, vocab: str, end_id: int, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None) -> None:
    """Write the ids of docs under path, in ascending doc_id order (null first; ties by length and ids).

    path/codes has a code length for every id that occurs; path/blocks a file for each range of doc_ids, with rows of
    whole documents up to about BLOCK_IDS ids: shard, base (ids before it in the shard), doc_ids, doc_sizes, payload
    (the codes) and checkpoints (the bit offset of every STEP-th id). A block can be decoded alone, and from any of
    its checkpoints. Global counts reach the driver: one number for each id of the vocabulary.
    """
    spark = docs.sparkSession
    rows = stage(token_rows(docs, vocab, end_id, text, doc_id), "ids")

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in small_batches(batches, "ids"):
            n = np.bincount(_flat(b.column("ids").to_pylist(), sum(b.column("n").to_pylist())))
            if len(n) > len(total):
                n, total = total, n
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    got = rows.select("n", "ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(int(max(got.column("id").to_pylist(), default=-1)) + 1, dtype=np.int64)
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    lengths = code_lengths(counts, bits_for(int((counts > 0).sum())))
    codes = canonical(lengths)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": pa.array(used.astype(np.int32)), "bits": pa.array(lengths[used].astype(np.int32))})).coalesce(1).write.parquet(f"{path}/codes")
    held = spark.sparkContext.broadcast((codes, lengths))

    def blocks(batches) -> Iterator[pa.RecordBatch]:
        codes, lengths = held.value
        shard, base, docs, sizes, raw, have = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            payload, marks = pack(_flat(raw, have), codes, lengths)
            cols = [pa.array([shard], pa.int32()), pa.array([base], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([marks.astype(f"<u{marks.itemsize}").tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "base", "doc_ids", "doc_sizes", "payload", "checkpoints"])

        for b in small_batches(batches, "ids"):
            for d, n, ids in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                docs.append(d)
                sizes.append(n)
                raw.append(ids)
                have += n
                if have >= BLOCK_IDS:
                    yield block()
                    base, docs, sizes, raw, have = base + have, [], [], [], 0
        if docs:
            yield block()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "ids")
    ordered.mapInArrow(blocks, "shard int, base long, doc_ids array<long>, doc_sizes array<long>, payload binary, checkpoints binary").write.parquet(f"{path}/blocks")
    unstage(rows)


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids array<int>) of every document in files made by `write`; repeated and null
    ids have a row each, as they were written.

    What the driver gets: the code lengths (one for each id) and the sizes of the shards (one for each file).
    """
    codes = spark.read.parquet(f"{path}/codes").toArrow()
    lengths = np.zeros(int(max(codes.column("id").to_pylist(), default=-1)) + 1, dtype=np.uint8)
    lengths[codes.column("id").to_numpy()] = codes.column("bits").to_numpy()
    rows = spark.read.parquet(f"{path}/blocks")
    sums = rows.select("shard", F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(sums, key=lambda r: r.shard):
        starts[r.shard], total = total, total + r.n
    held = spark.sparkContext.broadcast((decode_table(lengths), starts))

    def run(batches) -> Iterator[pa.RecordBatch]:
        table, starts = held.value
        for b in small_batches(batches, "payload", 4 << 20):
            sizes = b.column("doc_sizes").to_pylist()
            ids = unpack(b.column("payload").to_pylist(), [np.frombuffer(x, dtype="<u4" if len(x) == 4 * -(-sum(z) // STEP) else "<u8") for x, z in zip(b.column("checkpoints").to_pylist(), sizes, strict=True)], [sum(x) for x in sizes], table)
            doc_ids = [d for x in b.column("doc_ids").to_pylist() for d in x]
            n = np.array([k for x in sizes for k in x], dtype=np.int64)
            begin = np.concatenate([starts[s] + at + np.cumsum([0, *x[:-1]]) for s, at, x in zip(b.column("shard").to_pylist(), b.column("base").to_pylist(), sizes, strict=True)])
            raw, ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(n)
            crc = [zlib.crc32(raw[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            cols = [pa.array(doc_ids, pa.int64()), pa.array(begin, pa.int64()), pa.array(n), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(list_array(ids.view(np.int32), n, pa.int32()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    bound_batches(spark)
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of documents, from files written and read back."""
    path = stage_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary(), 2)
    return read(spark, path)
