"""Provider calls: sliding counts in batch and stream, exact admission with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.links import number
from ..plans.session import ship, staged

#: Windows that a slice of time holds, and calls that a slice of a bucket holds where admission is decided.
SLICE, SLICE_ROWS = 16, 50_000


def _sliced(events: DataFrame, ts: str, seconds: int, slices: int = SLICE) -> DataFrame:
    """events with _slice and _own: every event in its slice of `slices` * seconds, and again, not its own, in the next one if
    that one's first events still look back on it. A bucket of any size lies in as many groups as it has slices."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = slices * max(1, seconds) * 1_000_000
    slice_ = (micros - F.pmod(micros, F.lit(span))) / span
    e = events.withColumn("_at", slice_.cast("long"))
    ahead = F.when(F.pmod(micros, F.lit(span)) >= span - seconds * 1_000_000, F.array(F.col("_at"), F.col("_at") + 1)).otherwise(F.array("_at"))
    return e.withColumn("_slice", F.explode(ahead)).withColumn("_own", F.col("_slice").eqNullSafe(F.col("_at"))).drop("_at")


def sliding_count(events: DataFrame, by: str, ts: str = "ts", seconds: int = 60, key: str = "event_id") -> DataFrame:
    """events with in_window: the bucket's events of the last `seconds`, this one's moment included. Counted within slices of
    time that overlap by `seconds`, so that no window spans a bucket; events without a time are each other's moment.

    The count is that up to this moment less that of what lies more than `seconds` back: both frames only grow, so that a
    slice is read once, while a frame that slides is summed anew for every moment."""
    upto = lambda end: f"count(*) OVER (PARTITION BY {by}, _slice ORDER BY {ts} RANGE BETWEEN UNBOUNDED PRECEDING AND {end})"
    before = f"INTERVAL {seconds * 1_000_000 + 1} MICROSECONDS PRECEDING"
    count = F.expr(f"{upto('CURRENT ROW')} - CASE WHEN {ts} IS NULL THEN 0 ELSE {upto(before)} END")
    return _sliced(events, ts, seconds).withColumn("in_window", count).where("_own").drop("_slice", "_own")


def admit_in_order(times: list[float], recent: list[float], seconds: float, limit: int) -> tuple[list[bool], list[float]]:
    """Which calls pass: fewer than `limit` admitted ones in the last `seconds`. Denied calls do not count."""
    out = []
    for t in times:
        recent = [r for r in recent if t - r < seconds]
        ok = len(recent) < limit
        if ok:
            recent.append(t)
        out.append(ok)
    return out, recent


def admit(events: DataFrame, by: str, ts: str = "ts", key: str = "event_id", seconds: int = 60, limit: int = 30, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """key, bucket, ts, admitted for a batch: of the calls of a bucket by (ts, key), those with fewer than `limit` admitted ones
    in the `seconds` before. Calls without a time are denied.

    A bucket's calls are parted where none came for `seconds`, since nothing carries over there, and what is left in one
    piece into slices of about slice_rows calls. All slices are decided at once, first as if nothing had been admitted
    before them; then those whose predecessor hands on other admitted moments than they had assumed are decided again,
    until none changes. So the result is that of one sequence, and a bucket of any size is spread over tasks.
    """
    spark = events.sparkSession
    ship(spark)
    kind = events.schema[by].dataType.simpleString()
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(by).alias("bucket"), F.col(ts).cast("timestamp").alias("ts"))
    timed = number(rows.where("ts IS NOT NULL"), ["bucket"], ["ts", "key"], "_n")
    timed = timed.withColumn("slice", F.floor((F.col("_n") - 1) / slice_rows)).withColumn("at", F.unix_micros("ts")).drop("_n")
    timed = staged(timed, "calls")
    ends = timed.groupBy("bucket", "slice").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    order = W.partitionBy("bucket").orderBy("slice")
    # a slice that begins after a pause assumes rightly that nothing is carried over
    known = staged(ends.withColumn("after", F.lead("slice").over(order)).withColumn("gap", F.lead("low").over(order) - F.col("high")), "slices")
    span = int(seconds * 1_000_000)

    def decide(k, table: pa.Table, had: pa.Table) -> pa.Table:
        carried = had.column("carried")[0].as_py() if had.num_rows else []
        table = table.sort_by([("at", "ascending"), ("key", "ascending")])
        ok, recent = admit_in_order(table.column("at").to_pylist(), list(carried or []), span, limit)
        return table.select(["key", "bucket", "ts", "slice"]).append_column("admitted", pa.array(ok, pa.bool_())).append_column("recent", pa.array([None] * (len(ok) - 1) + [recent], pa.list_(pa.int64())))

    schema = f"key long, bucket {kind}, ts timestamp, slice long, admitted boolean, recent array<long>"
    same = lambda a, b: a["bucket"].eqNullSafe(b["bucket"]) & (a["slice"] == b["slice"])
    carried = spark.createDataFrame([], f"bucket {kind}, slice long, carried array<long>")
    done, todo, given = None, timed, carried
    while True:
        decided = staged(todo.groupBy("bucket", "slice").cogroup(given.groupBy("bucket", "slice")).applyInArrow(decide, schema), "decided")
        done = decided if done is None else staged(done.join(decided.select("bucket", "slice").distinct(), same(done, decided), "left_anti").unionByName(decided), "decided")
        ended = decided.where("recent IS NOT NULL").select("bucket", "slice", "recent")
        moved = ended.join(known.where(F.col("gap") < span).select(F.col("bucket").alias("_b"), F.col("slice").alias("_s"), "after"), F.col("bucket").eqNullSafe(F.col("_b")) & (F.col("slice") == F.col("_s")))
        # of what is handed on, only moments that the next slice can see matter
        lows = known.select(F.col("bucket").alias("_nb"), F.col("slice").alias("_ns"), "low")
        moved = moved.join(lows, F.col("bucket").eqNullSafe(F.col("_nb")) & (F.col("after") == F.col("_ns")))
        now = moved.select("bucket", F.col("after").alias("slice"), F.filter("recent", lambda r: F.col("low") - r < span).alias("carried"))
        was = carried.select(F.col("bucket").alias("_b"), F.col("slice").alias("_s"), F.col("carried").alias("_was"))
        new = now.join(was, F.col("bucket").eqNullSafe(F.col("_b")) & (F.col("slice") == F.col("_s")), "left")
        new = staged(new.where(~F.coalesce("_was", F.array().cast("array<long>")).eqNullSafe(F.col("carried"))).select("bucket", "slice", "carried"), "carried")
        if new.isEmpty():
            break
        carried = staged(carried.join(new, same(carried, new), "left_anti").unionByName(new), "all-carried")
        todo, given = timed.join(new, same(timed, new), "left_semi"), new
    untimed = rows.where("ts IS NULL").withColumn("admitted", F.lit(False))
    return done.select("key", "bucket", "ts", "admitted").unionByName(untimed)


def cooldown(events: DataFrame, by: str | None, limited: Column, ts: str = "ts", seconds: int = 3) -> DataFrame:
    """events with ready: when a call may go out, its own moment or `seconds` after the last call before it that the provider
    limited, of its bucket or, with by=None, of all: one clock stops them all. Looked up within slices of time that overlap
    by `seconds`. A limited call further back changes nothing, so that the frame begins with the slice and only grows."""
    e = _sliced(events.withColumn("_hit", F.when(limited, F.col(ts))), ts, seconds, slices=SLICE if by else 1)
    of = f"{by}, " if by else ""
    last = F.expr(f"max(_hit) OVER (PARTITION BY {of}_slice ORDER BY {ts} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)")
    until = F.greatest(F.col(ts), last + F.expr(f"INTERVAL {seconds} SECONDS"))
    return e.withColumn("ready", until).where("_own").drop("_hit", "_slice", "_own")


class _Cooldown(StatefulProcessor):
    """Keeps the moment until which a bucket's calls wait; a timer forgets it."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["ts", "key"], kind="stable").reset_index(drop=True)
        had = self.until.get()
        until, ready, pending = had[0] if had else float("-inf"), [], []
        for moment, hit in zip([t.timestamp() for t in f["ts"]], f["limited"], strict=True):
            # a limited call counts for what comes after its moment
            until = max([until, *(p + self.seconds for p in pending if p < moment)])
            pending = [p for p in pending if p >= moment]
            ready.append(max(moment, until))
            if hit:
                pending.append(moment)
        until = max([until, *(p + self.seconds for p in pending)])
        if until > float("-inf"):
            self.until.update((until,))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(1000 * until) + 1)
        yield f.assign(ready=pd.to_datetime(pd.Series(ready, dtype="float64").mul(1e6).round().astype("int64"), unit="us"))[["key", "bucket", "ts", "ready"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def cooldown_stream(events: DataFrame, by: str | None, limited: Column, ts: str = "ts", key: str = "event_id", seconds: int = 3, late: int = 600) -> DataFrame:
    """The stream of cooldown: key, bucket, ts, ready. Needs the RocksDB state store. A bucket holds one number, and none once
    the watermark has passed it; with by=None one clock holds for all, and all calls are one key by its nature. Calls of one
    trigger are taken in order; those that come after a later trigger's see the later clock."""
    ship(events.sparkSession)
    kind = events.schema[by].dataType.simpleString() if by else "string"
    rows = events.select(F.col(key).cast("long").alias("key"), (F.col(by) if by else F.lit("all")).alias("bucket"), F.col(ts).alias("ts"), limited.alias("limited"))
    rows = rows.withColumn("clock", F.col("ts") + F.expr(f"INTERVAL {late} SECONDS")).withWatermark("clock", f"{late} seconds")
    return rows.groupBy("bucket").transformWithStateInPandas(_Cooldown(seconds), f"key long, bucket {kind}, ts timestamp, ready timestamp", "Append", "EventTime")


class _Admission(StatefulProcessor):
    """Keeps the admitted moments of a bucket; when the watermark has passed its last call's window, the bucket is forgotten."""

    def __init__(self, seconds: int, limit: int, late: int):
        self.seconds, self.limit, self.late = seconds, limit, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "times array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["ts", "key"], kind="stable")
        had = self.recent.get()
        times = [t.timestamp() for t in f["ts"]]
        ok, recent = admit_in_order(times, list(had[0]) if had else [], self.seconds, self.limit)
        self.recent.update((recent,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(int(1000 * (max([*recent, *times]) + self.seconds + self.late)) + 1)
        yield f.assign(admitted=ok)[["key", "bucket", "ts", "admitted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, by: str, ts: str = "ts", key: str = "event_id", seconds: int = 60, limit: int = 30, late: int = 600) -> DataFrame:
    """The stream of admit: needs the RocksDB state store. Calls that come more than `late` seconds after later ones are left
    out; a bucket whose last call's window lies further back than that holds no state."""
    ship(events.sparkSession)
    kind = events.schema[by].dataType.simpleString()
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(by).alias("bucket"), F.col(ts).alias("ts"))
    # a clock that runs `late` ahead, so that the first moments of a stream are not behind its watermark
    rows = rows.withColumn("clock", F.col("ts") + F.expr(f"INTERVAL {late} SECONDS")).withWatermark("clock", f"{late} seconds")
    return rows.groupBy("bucket").transformWithStateInPandas(_Admission(seconds, limit, late), f"key long, bucket {kind}, ts timestamp, admitted boolean", "Append", "EventTime")


def usage(events: DataFrame, by: str, ts: str = "ts", every: str = "1 minute", late: str | None = None) -> DataFrame:
    """Calls of each bucket in each interval; `late` is the watermark of a stream."""
    e = events.withWatermark(ts, late) if late else events
    return e.groupBy(F.window(ts, every).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
