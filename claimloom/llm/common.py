"""What the corpus operators share: staging in the cluster's folder, bounded Arrow batches, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship

BATCH_ROWS = 256
BATCH_BYTES = 8 << 20
_own_folder: list[str] = []
#: In a Python worker: how to empty what an operator keeps between batches.
worker_caches: dict[str, Callable[[], None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in a local session, whose tasks run in the driver, may it be unset."""
    at = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="claimloom-"))
        at = _own_folder[0]
    return at.rstrip("/")


def stage_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/claimloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and a lost executor loses nothing."""
    path = stage_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class ByteCache(dict):
    """What make(key) gives by key, the oldest out when the keys together are over `most` in length; larger keys are not kept."""

    def __init__(self, name: str, make: Callable, most: int):
        self.name, self.make, self.most, self.size = name, make, most, 0

    def __missing__(self, key):
        got = self.make(key)
        if len(key) <= self.most:
            worker_caches.setdefault(self.name, self.empty)
            while self and self.size + len(key) > self.most:
                old = next(iter(self))
                self.size -= len(old)
                del self[old]
            self[key] = got
            self.size += len(key)
        return got

    def empty(self) -> None:
        self.clear()
        self.size = 0


def set_aside(df: DataFrame, used: Iterable[str], replaced: Iterable[str] = ()) -> tuple[DataFrame, dict[str, str]]:
    """df without the columns `replaced`, whose columns other than `used` have names that no operator takes, and what each
    column of the result was called."""
    used, gone = set(used), set(replaced)
    kept = [c for c in df.columns if c not in gone or c in used]
    names = [c if c in used else f"other_column_{k}" for k, c in enumerate(df.columns)]
    out = df.toDF(*names).select(*[n for n, c in zip(names, df.columns, strict=True) if c in kept])
    return out, {n: c for n, c in zip(names, df.columns, strict=True) if c in kept}


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, for tables with very long texts; and see that the executors have this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def small_batches(batches: Iterable[pa.RecordBatch], text: str, most: int = BATCH_BYTES, cache: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column `text` has about `most` bytes in each. Caches that operators other than `cache` have
    left in this worker are emptied first: workers live on from task to task."""
    for name in [k for k in worker_caches if k != cache]:
        worker_caches.pop(name)()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        parts = max(1, -(-batch.column(text).nbytes // most))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def list_array(values, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each row's list."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def components(edges: DataFrame, tag: str = "cc", most_rounds: int | None = None) -> DataFrame:
    """Connected components of edges(a, b): one row (node, comp) per node, comp being the component's smallest node.

    Alternating large-star and small-star rounds until nothing changes; each joins a node's neighbours with the smallest
    of them. What a round looks up is written first, so that a node with very many neighbours costs a partial aggregate
    and a plain join, which adaptive execution splits or broadcasts. More than most_rounds raise an error; there is no
    incomplete result. Self-loops and null ends are ignored; an empty edge table gives an empty result.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(e, f"{tag}-0")
    before, k = _mark(now), 0
    while before[0]:
        if most_rounds is not None and k >= most_rounds:
            raise RuntimeError(f"components are not complete after {most_rounds} rounds")
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m")), f"{tag}-m{k}")
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mid = stage(large, f"{tag}-l{k}")
        low2 = stage(mid.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), f"{tag}-n{k}")
        small = mid.join(low2, mid.a == low2.u).select("a", "b", "m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct()
        after = stage(small, f"{tag}-s{k}")
        for d in (now, low, mid, low2):
            unstage(d)
        mark, now, k = _mark(after), after, k + 1
        if mark == before:
            break
        before = mark
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
