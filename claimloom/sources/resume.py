"""Long jobs over growing folders that go on where they were stopped, with every row written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_resumable(spark: SparkSession, source: str, schema: str | T.StructType, out: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], format: str = "json", files: int = 16, **options: str) -> None:
    """make(rows) of all files of `source` that have not been done, in batches of at most `files` files, written to `out`.

    What is done is the stream's offsets in `checkpoint`. A batch has a folder of its own in `out`, named by its number, and
    replaces it: a batch that was written, but not noted as done when the job stopped, is made from the same files again
    and replaces itself, so that no row is lost or written twice. make must give the same rows for the same files if
    reruns are to agree; it may call models (slots), and rows of one batch fail together. Later runs take new files only.
    """

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    rows = spark.readStream.schema(schema).format(format).options(**options).option("maxFilesPerTrigger", files).load(source)
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def written(spark: SparkSession, out: str, schema: str | T.StructType) -> DataFrame:
    """All rows written so far, of all batches."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def progress(rows: DataFrame, by: tuple[str, ...] = ("split", "lang"), key: str | None = None) -> DataFrame:
    """How many rows of each part are done and, with a key, the largest key of each."""
    return rows.groupBy(*by).agg(F.count("*").alias("done"), *([F.max(key).alias("last")] if key else []))
