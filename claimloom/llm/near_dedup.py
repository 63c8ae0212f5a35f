"""Near-duplicate groups: b-bit MinHash candidates, exact confirmation, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ByteCache, bound_batches, components, list_array, small_batches, stage, unstage, utf8, worker_caches

WIDTH = 5
BANDS, ROWS, LOW_BITS = 32, 4, 2
MINIMA = BANDS * ROWS
WORDS = MINIMA * LOW_BITS // 64
#: One-bit minima of the few texts whose pairs are looked at across components.
LONG = 2048
#: Ids of texts to be compared that are broadcast as a semi-join, 40 MB with their nodes; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Nodes of a band's group that meet the whole group in one task.
PAIR_BLOCK = 512

_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_L = _rng.integers(1, 1 << 63, LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = _rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_Q = _rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    """64-bit hashes of words; emptied when it has grown to 300,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def _forget() -> None:
    _words.clear()
    _sets.empty()


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def words_of(text: bytes) -> list[bytes]:
    """ASCII-lower-cased words; bytes.split() cuts at \\x20 and \\x09-\\x0D and nothing else."""
    return text.lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole sequence if it has fewer words; none of no words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    worker_caches["near_dedup"] = _forget
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(WIDTH, len(h))
    n = len(h) - k + 1
    s = h[:n] * _P[0] + np.uint64(k)
    for j in range(1, k):
        s = _mix(s) + h[j : j + n] * _P[j]
    return np.unique(_mix(s))


def minima(s: np.ndarray, by: np.ndarray = _A) -> np.ndarray:
    out, step = np.full(len(by), np.uint64(0xFFFFFFFFFFFFFFFF)), (1 << 18) // len(by)
    for at in range(0, len(s), step):
        np.minimum(out, (s[at : at + step, None] * by).min(0), out=out)
    return out


def long_bits(s: np.ndarray) -> np.ndarray:
    """One bit of each of LONG minima, packed."""
    return np.packbits((_mix(minima(s, _L)) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def pack(m: np.ndarray) -> np.ndarray:
    """The low bits of the (mixed) minima of one set or of each row, LOW_BITS each, in WORDS longs."""
    low = (_mix(m) & np.uint64((1 << LOW_BITS) - 1)).reshape(*m.shape[:-1], WORDS, 64 // LOW_BITS)
    return np.bitwise_or.reduce(low << (np.arange(64 // LOW_BITS, dtype=np.uint64) * np.uint64(LOW_BITS)), axis=-1)


def band_keys(m: np.ndarray) -> np.ndarray:
    k = m.reshape(*m.shape[:-1], BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        out = _mix(out ^ (k[..., j] * _Q[j]))
    return out


def same_low(a: str, b: str) -> Column:
    """How many of the packed values agree: XOR folded to a bit a value, counted."""
    odd = F.lit(0x5555555555555555)
    miss = F.lit(0)
    for k in range(WORDS):
        x = F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}"))
        miss = miss + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    return F.lit(MINIMA) - miss


def estimate(a: str, b: str) -> Column:
    """Similarity from the share of agreeing low bits, less the chance agreement 2**-LOW_BITS of different minima."""
    chance = 2.0**-LOW_BITS
    return (same_low(a, b) / F.lit(float(MINIMA)) - chance) / (1 - chance)


def long_estimate(a: str, b: str) -> Column:
    """Similarity from LONG minima of one bit each, in arrays of longs."""
    miss = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 - miss * (2.0 / LONG)


def floor_of(similarity: float, minima: int = MINIMA, bits: int = LOW_BITS) -> float:
    """An estimate lies below this once in 10**7 cases for sets as similar as `similarity`: 5.2 standard deviations."""
    chance = 2.0**-bits
    p = similarity + (1 - similarity) * chance
    return similarity - 5.2 * (p * (1 - p) / minima) ** 0.5 / (1 - chance)


SIGNATURES = "_row long, doc_id long, n_shingles long, node binary, sig struct<w0:long,w1:long,w2:long,w3:long>, bands array<long>"


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", row_id: str | None = None) -> DataFrame:
    """A row for each row of docs: node is a 128-bit hash of the words, which equal sequences share; null without words."""
    bound_batches(docs.sparkSession)

    def sign(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", cache="near_dedup"):
            node, size, mins, known, at = [], [], [], {}, []
            for t in utf8(b.column("text")):
                words = words_of(t)
                key = xxhash.xxh3_128_digest(b" ".join(words)) if words else None
                node.append(key)
                if key is not None and key not in known:
                    s = shingles(words)
                    known[key] = (len(known), len(s))
                    mins.append(minima(s))
                size.append(known[key][1] if words else 0)
                at.append(known[key][0] if words else 0)
            m = np.array(mins).reshape(-1, MINIMA) if mins else np.zeros((1, MINIMA), dtype=np.uint64)
            sig, bands = pack(m)[at].view(np.int64), band_keys(m)[at].view(np.int64)
            sig = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(sig[:, k])) for k in range(WORDS)], [f"w{k}" for k in range(WORDS)])
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.binary()), sig, list_array(bands.ravel(), np.full(len(at), BANDS), pa.int64())], ["_row", "doc_id", "n_shingles", "node", "sig", "bands"])

    rows = docs.select((F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, SIGNATURES)


#: Sets of the texts that many others are compared with, for up to 4 MB of texts.
_sets = ByteCache("near_dedup", lambda text: shingles(words_of(text)), 4 << 20)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return both * 100 >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) of nodes whose full shingle sets have 100 * intersection >= percent * union. texts(node, text) has
    each node once and is a written table, so that both joins are plain ones: many a of one b (a hot group's leader)
    are rows of the large side, which adaptive execution splits. b's set is kept while its rows follow one another."""

    def check(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "ta", cache="near_dedup"):
            ok = [_alike(shingles(words_of(x)), _sets[y], percent) for x, y in zip(utf8(b.column("ta")), utf8(b.column("tb")), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")


def _texts_of(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(node, text) for the representatives in ids(doc_id, node). Few ids are broadcast to spare the other texts a shuffle.

    A doc_id may belong to rows with other texts: the node is computed again and must be the one asked for.
    """

    def nodes(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", cache="near_dedup"):
            texts = utf8(b.column("text"))
            keys = [xxhash.xxh3_128_digest(b" ".join(w)) if (w := words_of(t)) else None for t in texts]
            keep = pa.array([k == n for k, n in zip(keys, b.column("node").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("node").filter(keep), b.column("text").filter(keep)], ["node", "text"])

    right = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    got = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("text")).join(right, F.col("_id").eqNullSafe(F.col("doc_id"))).select("node", "text")
    return got.mapInArrow(nodes, "node binary, text string").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 75, row_id: str | None = None) -> DataFrame:
    """_row, doc_id, n_shingles, component_id, kept, first for each row of docs.

    _row is the column row_id of docs, which must be unique, or else a number of the row in this result.

    Texts with the same words are one node. A band's nodes are candidates, but only their components matter, so a group
    of m near copies costs m comparisons, not m * m: each node is compared with the band's smallest; where a band still
    has nodes of several components, with its most central one; then nodes across components with each other, in blocks of PAIR_BLOCK by a whole group. Before
    that, the shingles that a node shares with other components are counted: nodes or pairs that these cannot bring to
    the threshold are out, which is exact. Pairs pass the packed low bits within the join, in the first band they share, then their full
    sets are compared. 32 bands of 4 minima miss a pair at similarity 0.75 once in 190,000 cases, and at 0.8 once in 10 million.

    component_id is the smallest doc_id of the component; kept is doc_id = component_id; first marks one row of each
    component, the first of those with the smallest doc_id. A null or empty text is a component of its own; a null
    doc_id ranks last, and where all ids of a component are null component_id is null and kept true. Rows with equal
    ids but different texts stay separate nodes. Other columns of docs are ignored.
    """
    sigs = stage(signatures(docs, text, doc_id, row_id), "sigs")
    nodes = stage(sigs.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    in_bands = nodes.select("node", F.explode("bands").alias("key"))
    shared = stage(in_bands.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").drop("last"), "shared")
    bands = stage(in_bands.join(shared, "key").select("key", F.col("node").alias("a"), "b"), "bands")
    sig = nodes.select("node", "sig")

    def likely(pairs: DataFrame) -> DataFrame:
        p = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
        return p.where(estimate("sa", "sb") >= floor_of(percent / 100)).select("a", "b")

    stars = stage(likely(bands.where("a <> b").select("a", "b").distinct()), "stars")
    texts = stage(_texts_of(docs, _node_ids(bands.select("a"), nodes), text, doc_id), "texts")
    whole = _linked(nodes, confirm(stars, texts, percent), None, "cc1")

    open_ = _open(bands, whole, "open1")
    if open_.isEmpty():
        return _grouped(sigs, nodes, whole)
    mass = _shared_mass(open_, texts)
    n = nodes.select(F.col("node").alias("a"), "sig", "n_shingles")
    open_ = stage(open_.join(mass, "a").join(n, "a").where(_can_link("n_shingles", "shared", "shared", "shared", percent)), "open2")
    central = open_.groupBy("key").agg(F.max(F.struct((F.col("shared") / F.col("n_shingles")).alias("share"), F.col("a").alias("b"), F.col("comp").alias("cb"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"), F.col("shared").alias("mb"))).alias("l")).select("key", "l.*")
    central = stage(central, "central")
    to_center = open_.join(central, "key").where("comp <> cb").select("a", "b", F.col("sig").alias("sa"), "sb", F.col("n_shingles").alias("na"), "nb", F.col("shared").alias("ma"), "mb")
    stars2 = to_center.where((estimate("sa", "sb") >= floor_of(percent / 100)) & _can_link("na", "nb", "ma", "mb", percent)).select("a", "b").distinct()
    stars2 = stage(stars2.join(stars, ["a", "b"], "left_anti"), "stars2")
    whole = _linked(nodes, confirm(stars2, texts, percent), whole, "cc2")

    rest = _open(open_.select("key", "a"), whole, "open3")
    if rest.isEmpty():
        return _grouped(sigs, nodes, whole)
    rest = rest.join(mass, "a").join(n.join(nodes.select(F.col("node").alias("a"), "bands"), "a"), "a")
    rest = rest.join(_sketches(texts.join(rest.select(F.col("a").alias("node")).distinct(), "node", "left_semi")), "a")
    rest = stage(rest, "rest")
    blocks = stage(rest.groupBy("key").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks")), "blocks")
    rest = rest.join(blocks, "key")
    side = lambda x, block: rest.select("key", block.alias("block"), F.col("a").alias(x), F.col("comp").alias(f"c{x}"), F.col("sig").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("shared").alias(f"m{x}"), F.col("long").alias(f"l{x}"), F.col("bands").alias(f"k{x}"))
    x, y = side("a", F.pmod(F.xxhash64("a"), "blocks").cast("int")), side("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    across = x.join(y, (x.key == y.key) & (x.block == y.block) & (F.col("ca") < F.col("cb")) & _can_link("na", "nb", "ma", "mb", percent) & (estimate("sa", "sb") >= floor_of(percent / 100)) & (long_estimate("la", "lb") >= floor_of(percent / 100, LONG, 1)) & (x.key == F.array_min(F.array_intersect("ka", "kb")))).select("a", "b")
    done = stars.union(stars2)
    across = stage(across.join(done.union(done.select("b", "a")), ["a", "b"], "left_anti"), "across")
    whole = _linked(nodes, confirm(across, texts, percent), whole, "cc3")
    for d in (bands, stars, texts, open_, mass, stars2, across):
        unstage(d)
    return _grouped(sigs, nodes, whole)


def _grouped(sigs: DataFrame, nodes: DataFrame, whole: DataFrame) -> DataFrame:
    """The result's rows from the components (node, comp) of linked nodes."""
    labels = nodes.select("node", "doc_id").join(whole, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    low = labels.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_node = labels.join(low, "comp").select("node", "component_id", "comp")
    out = sigs.select("_row", "doc_id", "n_shingles", "node").join(of_node, "node", "left")
    lead = stage(out.where("node IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row")), "lead").select("_row", F.lit(True).alias("first"))
    out = out.join(lead, "_row", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("_row", "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.coalesce("first", F.lit(False)) | F.col("node").isNull()).alias("first"))


def _node_ids(some: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node) of the representatives of the nodes in some(a)."""
    return stage(some.select(F.col("a").alias("node")).distinct().join(nodes.select("node", "doc_id"), "node").select("doc_id", "node"), "ids")


def _linked(nodes: DataFrame, links: DataFrame, known: DataFrame | None, tag: str) -> DataFrame:
    """(node, comp) of linked nodes: components of the links, between the components known so far if there are any."""
    links = stage(links, f"{tag}-links")
    if known is None:
        return stage(components(links, tag), f"{tag}-comp")
    if links.isEmpty():
        return known
    of = lambda x: known.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = stage(components(between, tag), f"{tag}-top").select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    every = known.union(top.select(F.col("comp").alias("node"), "comp").join(known.select("node"), "node", "left_anti"))
    return stage(every.join(top, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), f"{tag}-comp")


def _open(bands: DataFrame, comps: DataFrame, tag: str) -> DataFrame:
    """(key, a, comp): the nodes of bands whose nodes are in more than one component."""
    members = stage(bands.select("key", "a").join(comps.select(F.col("node").alias("a"), "comp"), "a", "left").select("key", "a", F.coalesce("comp", "a").alias("comp")), f"{tag}-members")
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return stage(members.join(stage(mixed, f"{tag}-mixed"), "key"), tag)


def _shared_mass(open_: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, shared): how many of an open node's shingles a node of another component has too. No pair can have more in common."""

    def explode(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 1 << 20, "near_dedup"):
            sets = [shingles(words_of(t)) for t in utf8(b.column("text"))]
            at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            flat = np.concatenate(sets).view(np.int64)
            for k in range(0, len(at), 1 << 16):
                rows = pa.array(at[k : k + (1 << 16)])
                yield pa.RecordBatch.from_arrays([b.column("node").take(rows), b.column("comp").take(rows), pa.array(flat[k : k + (1 << 16)])], ["a", "comp", "g"])

    of = open_.select(F.col("a").alias("node"), "comp").distinct()
    each = stage(texts.join(of, "node").select("node", "comp", "text").mapInArrow(explode, "a binary, comp binary, g long"), "shingles")
    common = each.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g")
    return stage(each.select("a", "g").join(common, "g").groupBy("a").agg(F.count("*").alias("shared")), "mass")


def _sketches(texts: DataFrame) -> DataFrame:
    """(a, long) of texts(node, text)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 1 << 20, "near_dedup"):
            bits = np.stack([long_bits(shingles(words_of(t))) for t in utf8(b.column("text"))])
            yield pa.RecordBatch.from_arrays([b.column("node"), list_array(bits.ravel(), np.full(len(bits), LONG // 64), pa.int64())], ["a", "long"])

    return stage(texts.select("node", "text").mapInArrow(run, "a binary, long array<long>"), "sketches")


def _can_link(na: str, nb: str, ma: str, mb: str, percent: int) -> Column:
    """Whether sets of na and nb shingles, of which ma and mb are shared with any other component, can be similar enough."""
    m = F.least(ma, mb)
    return m * (100 + percent) >= (F.col(na) + F.col(nb)) * percent


def op2(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "kept")
