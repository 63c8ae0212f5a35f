"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
#: Spark's setting by which what a query shuffled goes when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, UTC and small Arrow batches; conf has underscores for dots in its names."""
    b = SparkSession.builder.appName("claimloom")
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}
    return b.config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once, unless their PYTHONPATH has it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="claimloom-"), "claimloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((ROOT / "claimloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(path)


_own_folder: list[str] = []


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the folder that driver and executors share, spark.checkpoint.dir, and read back: its lineage
    ends here and a lost executor loses nothing. Only a local session may leave the folder unset. The files go when the
    application ends, what was shuffled for them once they are written."""
    spark = df.sparkSession
    sc, at = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", "") or ""
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="claimloom-"))
        at = _own_folder[0]
    path = f"{at.rstrip('/')}/claimloom-base/{sc.applicationId}/{tag}-{uuid.uuid4().hex}"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    was = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREED, was)
    return spark.read.schema(df.schema).parquet(path)
