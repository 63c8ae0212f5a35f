import random
import re

from pyspark.sql import functions as F

from claimloom.streaming import limits as L


def model(times, seconds, limit):
    recent, out = [], []
    for x in times:
        recent = [r for r in recent if x - r < seconds]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(x)
    return out


def rows(spark):
    times = [0, 10, 20, 59, 60, 61, 75, 130]
    d = spark.createDataFrame([(i, "k", t) for i, t in enumerate(times)], "event_id long, user_id string, t long")
    return times, d.withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_denied_calls_do_not_count(spark):
    times, d = rows(spark)
    got = [r.admitted for r in L.admit(d, "user_id", seconds=60, limit=2).orderBy("key").collect()]
    assert got == model(times, 60, 2)
    assert sum(got) != sum(r.in_window <= 2 for r in L.sliding_count(d, "user_id", seconds=60).collect())


def test_stream_counts_equal_batch(spark, tmp_path):
    _, d = rows(spark)
    d.write.parquet(str(tmp_path / "in"))
    s = L.usage(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "user_id", late="1 minute")
    q = s.writeStream.outputMode("complete").format("memory").queryName("usage_test").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("usage_test").collect())) == sorted(map(tuple, L.usage(d, "user_id").collect()))


def test_stream_admits_as_the_batch_does(spark, tmp_path):
    """Two files arrive one after the other; the second's calls meet the state of the first's."""
    times, d = rows(spark)
    for k, part in enumerate((d.where("event_id < 4"), d.where("event_id >= 4"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = tmp_path / "src"
        src.mkdir()
        s = L.admit_stream(spark.readStream.schema(d.schema).parquet(str(src)), "user_id", seconds=60, limit=2)
        for k in range(2):
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                f.rename(src / f"{k}-{f.name}")
            q = s.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
            q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [r.admitted for r in spark.read.parquet(str(tmp_path / "out")).orderBy("key").collect()]
    assert got == model(times, 60, 2)


def test_idle_buckets_hold_no_state(spark, tmp_path):
    """The first file's bucket is forgotten once the second file's calls have moved the watermark past its window."""
    d = spark.createDataFrame([(1, "a", 1000), (2, "b", 90000), (3, "b", 90001)], "event_id long, user_id string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = tmp_path / "src"
        src.mkdir()
        s = L.admit_stream(spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(src)), "user_id", seconds=60, limit=2, late=60)
        for k in range(3):
            d.where(F.col("event_id") == k + 1).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            for f in (tmp_path / f"part{k}").glob("*.parquet"):
                f.rename(src / f"{k}-{f.name}")
        q = s.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert [r.admitted for r in spark.read.parquet(str(tmp_path / "out")).orderBy("key").collect()] == [True, True, True]
    assert held[:3] == [1, 2, 1] and held[-1] == 1


def test_admission_by_slices(spark):
    """Buckets with pauses, without any for long, ties, nulls; slices of a few calls hand on what they have admitted."""
    rng = random.Random(8)
    rows, at = [], 0
    for k in range(400):
        at += rng.choice([0, 1, 3, 20, 59, 60, 200]) if k % 3 else rng.choice([0, 1, 2])
        rows.append((k, rng.choice(["a", "a", "a", "b", None]), at))
    rows += [(1000 + k, "dense", k * 7) for k in range(150)] + [(5000, "a", None), (5001, "a", None)]
    d = spark.createDataFrame(rows, "event_id long, user_id string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want = {5000: False, 5001: False}
    for b in ("a", "b", None, "dense"):
        mine = sorted((t, k) for k, x, t in rows if x == b and t is not None)
        want |= {k: ok for (_, k), ok in zip(mine, model([t for t, _ in mine], 60, 5), strict=True)}
    for size in (7, 10_000):
        assert {r.key: r.admitted for r in L.admit(d, "user_id", seconds=60, limit=5, slice_rows=size).collect()} == want


def test_slices_of_time(spark):
    """Counts and waits of slices equal those of one window over a bucket; no window spans a bucket."""
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([-5000.0, 0.0, 3000.0]) + rng.randint(0, 900) + rng.choice([0, 0.5]), rng.random() < 0.2) for k in range(500)] + [(900, "a", None, True), (901, "a", None, False)]
    d = spark.createDataFrame(rows, "event_id long, user_id string, t double, hit boolean").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    counts = {r.event_id: r.in_window for r in L.sliding_count(d, "user_id", seconds=60).collect()}
    plain = lambda b, t: 2 if t is None else sum(x == b and u is not None and t - 60 <= u <= t for _, x, u, _ in rows)
    assert counts == {k: plain(b, t) for k, b, t, _ in rows}
    for by in ("user_id", None):
        got = {r.event_id: r.ready and r.ready.timestamp() for r in L.cooldown(d, by, F.col("hit"), seconds=30).collect()}
        wait = lambda b, t: None if t is None else max([t, *(u + 30 for _, x, u, hit in rows if hit and u is not None and (by is None or x == b) and t - 30 <= u < t)])
        assert got == {k: wait(b, t) for k, b, t, _ in rows}


def test_stream_cools_down_as_the_batch_does(spark, tmp_path):
    d = spark.createDataFrame([(0, 0, False), (1, 1, True), (2, 2, False), (3, 3, True), (4, 5, False), (5, 7, False), (6, 7, True), (7, 8, False), (8, 11, False)], "event_id int, t long, limited boolean").withColumn("ts", F.timestamp_seconds("t")).withColumn("b", F.when(F.col("event_id") < 4, "x").otherwise("y")).drop("t")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for by in ("b", None):
            src = tmp_path / f"src{by}"
            src.mkdir()
            s = L.cooldown_stream(spark.readStream.schema(d.schema).parquet(str(src)), by, F.col("limited"), seconds=3)
            for k, part in enumerate((d.where("event_id < 4"), d.where("event_id >= 4"))):
                part.coalesce(1).write.parquet(str(tmp_path / f"part{by}{k}"))
                for f in (tmp_path / f"part{by}{k}").glob("*.parquet"):
                    f.rename(src / f"{k}-{f.name}")
                q = s.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / f"out{by}")).option("checkpointLocation", str(tmp_path / f"cp{by}")).trigger(availableNow=True).start()
                assert q.awaitTermination(120)
            got = {r.key: r.ready for r in spark.read.parquet(str(tmp_path / f"out{by}")).collect()}
            assert got == {r.event_id: r.ready for r in L.cooldown(d, by, F.col("limited"), seconds=3).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_frames_only_grow(spark):
    """A frame that slides is summed anew for every moment: the square of a slice's events."""
    d = spark.range(10).select(F.col("id").alias("event_id"), F.lit("a").alias("user_id"), F.timestamp_seconds("id").alias("ts"))
    for out in (L.sliding_count(d, "user_id", seconds=60), L.cooldown(d, "user_id", F.col("event_id") % 7 == 0, seconds=30)):
        frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]*)", out._jdf.queryExecution().optimizedPlan().toString())
        assert frames and all(f.startswith("unboundedpreceding") for f in frames)
