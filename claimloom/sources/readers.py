"""Reading and writing the files that runs exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dataset import canonical_label, numbered
from ..plans.session import ship, staged
from .arrays import elements


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Line-delimited JSON with a schema; blank lines give no rows."""
    return spark.read.schema(schema).json(path)


def read_cases(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of files that are a JSON list, or an object with `claims` or `cases`, with or without a byte-order mark; of any
    size, read in splits (`sources.arrays`).

    row is the DDL of one row. A file of another shape, one that is broken, or an empty list, raises when it is read.
    """
    parts = elements(spark, path)
    name = F.regexp_replace("file", "^file:/+", "file:/").alias("file")  # listings and rows write it differently
    listed = spark.createDataFrame([(f,) for f in spark.read.text(path).inputFiles()], "file string").select(name)
    empty = listed.join(parts.select(name).distinct(), "file", "left_anti").limit(1).collect()
    if empty:
        raise ValueError(f"no rows in {empty[0].file}")
    checked = F.when(F.try_parse_json("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("broken row in "), F.col("file"))))
    return parts.select(F.from_json(checked, f"struct<{row}>").alias("r")).select("r.*")


def read_js_array(spark: SparkSession, path: str, name: str, row: str) -> DataFrame:
    """Rows of an array literal `name = [...]` in script code: keys are quoted and a comma before an end dropped."""
    body = F.regexp_extract("value", rf"(?s)\b{name}\s*=\s*(\[.*?\])\s*;", 1)
    body = F.regexp_replace(F.regexp_replace(body, r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":'), r",\s*([\]}])", "$1")
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json(body, f"array<struct<{row}>>")).alias("r")).select("r.*")


def read_csvs(spark: SparkSession, paths: list[str], kinds: dict[str, str]) -> DataFrame:
    """Files with headers, all their columns, those in kinds cast (null where that fails)."""
    out = None
    for p in paths:
        d = spark.read.csv(p, header=True)
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.withColumns({c: F.lower(F.col(c)).try_cast(k) if k == "boolean" else F.col(c).try_cast(k) for c, k in kinds.items()})


def read_by_language(spark: SparkSession, root: str) -> DataFrame:
    """Parquet under root/<lang>/<split>/ with lang and split from the path."""
    d = spark.read.option("recursiveFileLookup", "true").parquet(root)
    where = F.input_file_name()
    return d.withColumn("lang", F.regexp_extract(where, r"/([^/]+)/[^/]+/[^/]+$", 1)).withColumn("split", F.regexp_extract(where, r"/([^/]+)/[^/]+$", 1))


def select_cases(cases: DataFrame, bucket: str | None = None, seed: str | None = None, first: int | None = None, key: str = "id") -> DataFrame:
    """Cases of a language bucket (EN or MULTI, from the language where missing), in seeded order if asked, the first n."""
    b = F.upper(F.coalesce("lang_bucket", F.when(F.lower("language").isin("en", "english"), "EN").otherwise("MULTI")))
    out = cases.withColumn("lang_bucket", b)
    if bucket:
        out = out.where(F.col("lang_bucket") == bucket.upper())
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)] if seed is not None else [F.col(key)]
    return out.orderBy(*order).limit(first) if first is not None else out.orderBy(*order)


def read_pages_spec(spec: str, count: int, cap: int | None = None) -> list[int]:
    """Page numbers of `n`, `a-b` and lists of them: ranges may be swapped, pages out of range go, at most cap."""
    pages: list[int] = []
    for part in (spec or "").replace(";", ",").split(","):
        a, dash, b = (x.strip() for x in part.partition("-"))
        if a.isdigit() and (not dash or b.isdigit()):
            lo, hi = sorted((int(a), int(b) if dash else int(a)))
            pages += [p for p in range(max(lo, 1), min(hi, count) + 1) if p not in pages]
    pages = pages if (spec or "").strip() else list(range(1, count + 1))
    return pages[:cap] if cap else pages


def page_spec(spec, count):
    """read_pages_spec as a column: sorted distinct pages of a spec column within 1..count."""
    parts = F.filter(F.transform(F.split(F.replace(spec, F.lit(";"), F.lit(",")), ","), lambda x: F.trim(x)), lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    lo = lambda p: F.regexp_extract(p, r"^(\d+)", 1).cast("int")
    hi = lambda p: F.coalesce(F.when(F.regexp_extract(p, r"-\s*(\d+)$", 1) != "", F.regexp_extract(p, r"-\s*(\d+)$", 1).cast("int")), lo(p))
    every = F.flatten(F.transform(parts, lambda p: F.sequence(F.least(lo(p), hi(p)), F.least(F.greatest(lo(p), hi(p)), F.greatest(count, F.least(lo(p), hi(p)))))))
    return F.array_distinct(F.filter(every, lambda x: (x >= 1) & (x <= count)))


def best_ocr(results: DataFrame, by: list[str], primary: str, least: float = 0.70) -> DataFrame:
    """One result for each image: the primary engine's if it has text and enough confidence, else the most confident."""
    good = (F.col("engine") == primary) & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("confidence") >= least)
    rank = F.struct(good, F.coalesce("confidence", F.lit(0.0)), F.col("engine") == primary, "engine")
    return results.groupBy(*by).agg(F.max_by(F.struct("engine", "text", "confidence"), rank).alias("r")).select(*by, "r.*")


def word_confidence(words: DataFrame, by: list[str]) -> DataFrame:
    """Text and mean confidence / 100 of recognised words, those with a negative confidence aside."""
    ok = F.col("conf") >= 0
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(ok & (F.trim("word") != ""), F.struct("pos", "word")))), lambda x: x["word"]), " ")
    return words.groupBy(*by).agg(joined.alias("text"), (F.coalesce(F.avg(F.when(ok, F.col("conf"))), F.lit(0.0)) / 100).alias("confidence"))


def read_binary(spark: SparkSession, root: str, pattern: str = "*", convert=None) -> DataFrame:
    """Files as path, length, and content; or what convert (a pandas UDF of the content) makes of it, as `result`."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    return d if convert is None else d.select("path", "length", convert("content").alias("result"))


#: Image files, by their endings.
IMAGES = "*.{png,jpg,jpeg,webp,bmp,tif,tiff,PNG,JPG,JPEG,WEBP,BMP,TIF,TIFF}"


def ocr_rows(spark: SparkSession, root: str, engines: dict, primary: str, least: float = 0.70, pattern: str = IMAGES) -> DataFrame:
    """path, engine, text, confidence, words: the best reading (`best_ocr`) of every image under a folder.

    engines: for each name a loader, called once a task, which gives a function from a list of images' bytes to as many
    lists of (word, confidence in percent); words of a negative confidence count as none read, as in `word_confidence`. An
    image that an engine cannot read (None) has an empty text and confidence 0 of it. Images go through one pass in small
    batches; every engine reads each.
    """
    ship(spark)
    schema = "path string, engine string, text string, confidence double, words array<struct<word: string, conf: double>>"
    fields = [("path", pa.string()), ("engine", pa.string()), ("text", pa.string()), ("confidence", pa.float64()), ("words", pa.list_(pa.struct([("word", pa.string()), ("conf", pa.float64())])))]

    def run(batches) -> Iterator[pa.RecordBatch]:
        models = {name: load() for name, load in engines.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                paths, images, rows = part.column("path").to_pylist(), part.column("content").to_pylist(), []
                for name, model in models.items():
                    for path, words in zip(paths, model(images), strict=True):
                        read = [(str(w), float(c)) for w, c in words or [] if c >= 0]
                        text = " ".join(w for w, _ in read if w.strip())
                        rows.append((path, name, text, sum(c for _, c in read) / len(read) / 100 if read else 0.0, [{"word": w, "conf": c} for w, c in read]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    every = read_binary(spark, root, pattern).select("path", "content").mapInArrow(run, schema)
    every = staged(every, "ocr")  # a model is run once, not again for the choice
    return best_ocr(every, ["path"], primary, least).select("path", "engine").join(every, ["path", "engine"])


def read_labelled(rows: DataFrame, label: str, table: dict[str, str], most: int | None = None, seed: str = "0", key: str = "id") -> DataFrame:
    """rows of any data set with their labels in another's names (`canonical_label`), those without one left out, and at most
    `most` of each label, drawn by a seeded order of their keys."""
    out = rows.withColumn(label, canonical_label(F.col(label).cast("string"), table)).where(F.col(label).isNotNull())
    if most is None:
        return out
    return numbered(out, [label], [key], seed).where(F.col("_k") <= most).drop("_k", "_n")


def cap_chars(pages: DataFrame, by: list[str], page: str, text: str, most: int) -> DataFrame:
    """Pages in order until `most` characters are reached; the page that crosses is cut."""
    from pyspark.sql import Window as W

    before = F.coalesce(F.sum(F.length(text)).over(W.partitionBy(*by).orderBy(page).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("_before", before).where(F.col("_before") < most).withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(most) - F.col("_before")).cast("int"))).drop("_before")


def write_splits(rows: DataFrame, path: str, part: str = "split") -> None:
    rows.write.mode("overwrite").partitionBy(part).json(path)


def write_sorted(rows: DataFrame, path: str, part: str, key: str) -> None:
    """A file for each part, ordered by key."""
    rows.repartition(part).sortWithinPartitions(part, key).write.mode("overwrite").partitionBy(part).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_record(row: DataFrame, latest: str, log: str) -> None:
    """The newest record alone, and at the end of the log."""
    row.write.mode("overwrite").json(latest)
    row.write.mode("append").json(log)


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an earlier, interrupted run has not written."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def with_fallback(rows: DataFrame, by: list[str], tokens, haystack) -> DataFrame:
    """Rows that contain one of the tokens; all rows of a group where none does."""
    from pyspark.sql import Window as W

    hit = F.exists(tokens, lambda t: F.contains(haystack, t))
    r = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return r.withColumn("_any", F.max(F.col("_hit").cast("int")).over(W.partitionBy(*by))).where(F.col("_hit") | (F.col("_any") == 0)).drop("_hit", "_any")


def slot(function, kind: str):
    """A model as an Arrow-batched column function of one text column; null texts become empty."""

    @F.pandas_udf(kind)
    def run(c: pd.Series) -> pd.Series:
        return function(c.fillna(""))

    return run


def loaded_slot(load, kind: str):
    """A model as a column function of any number of text columns: load() gives, once for each task of a worker, a function of
    as many series; null texts become empty."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = load()
        for columns in batches:
            yield model(*[c.fillna("") for c in columns])

    return run


def relevance_of(logits) -> pd.Series:
    """Rows of logits as relevance: the sigmoid of a single one, else the second class's share."""
    x = np.asarray(logits, dtype=float)
    if x.ndim == 1 or x.shape[1] == 1:
        return pd.Series(1 / (1 + np.exp(-x.reshape(-1))))
    e = np.exp(x - x.max(1, keepdims=True))
    return pd.Series(e[:, 1] / e.sum(1))


# Names of a model's classes, and their order where a model does not name all three.
CLASSES = {"support": "support supported entailment entails true", "refute": "refute refuted contradiction contradicts false", "neutral": "neutral nei"}
CLASS_ORDER = ["support", "neutral", "refute"]


def class_order(names: dict | None) -> list[str | None]:
    """What each of a model's outputs stands for, from its names by index."""
    of = {w: k for k, ws in CLASSES.items() for w in ws.split()} | {"not enough info": "neutral"}
    found = {int(k): of.get(str(v).strip().lower()) for k, v in (names or {}).items() if str(k).strip().lstrip("-").isdigit()}
    return [found.get(i) for i in range(max(found) + 1)] if set(found.values()) >= set(CLASS_ORDER) else list(CLASS_ORDER)


def stance_of(logits, names: dict | None = None) -> pd.DataFrame:
    """Rows of logits as support, refute and neutral, whatever the order of the model's classes."""
    x = np.asarray(logits, dtype=float)
    e = np.exp(x - x.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    out = pd.DataFrame(0.0, index=range(len(p)), columns=["support", "refute", "neutral"])
    for i, name in enumerate(class_order(names)[: p.shape[1]]):
        if name:
            out[name] = p[:, i]
    return out


def verified(claims: DataFrame, evidence: DataFrame, by: str, pos: str, load=None) -> DataFrame:
    """claims with `answer`: what a verifier says of a claim and its numbered evidence; null where none is given.

    load() gives a function of two series, claims and evidence as text, once for each task. evidence has source, relevance
    and text; a claim's rows are those that its verdict is made of, a few."""
    from ..functions.text import snippets

    items = evidence.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(pos, "source", "relevance", "text"))).alias("_items"))
    shown = claims.join(items, by, "left").withColumn("_shown", F.coalesce(snippets(F.col("_items")), F.lit("")))
    answer = loaded_slot(load, "string")("claim", "_shown") if load else F.lit(None).cast("string")
    return shown.withColumn("answer", answer).drop("_items", "_shown")


def chained(first: DataFrame, text: str, keys: list[str], *slots) -> DataFrame:
    """first with `result`: each different text once through the slots in turn, a later one only where the earlier gave
    nothing; rows with equal texts share the result."""
    once = first.select(F.col(text).alias("_text")).where(F.coalesce("_text", F.lit("")) != "").distinct().withColumn("result", F.lit(None).cast("string"))
    for s in slots:
        open_ = F.coalesce("result", F.lit("")) == ""
        done = once.where(~open_)
        once = done.unionByName(once.where(open_).withColumn("result", s("_text")))
    return first.join(once, F.col(text) == F.col("_text"), "left").drop("_text")
