"""Evaluation tables: accuracy, confusion, precision and recall, AUC, before and after, timings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Quantiles at which distinct scores are parted.
PARTS = 256


def ratio(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def rollup_all(rows: DataFrame, by: str, aggs: list[Column]) -> DataFrame:
    """One row for each group and one called all, from one pass over the rows."""
    out = rows.rollup(by).agg(F.grouping(by).alias("_g"), *aggs)
    return out.withColumn(by, F.when(F.col("_g") == 1, "all").otherwise(F.col(by))).drop("_g")


def accuracy_table(rows: DataFrame, by: str, expected: str, before: str, after: str) -> DataFrame:
    hit = lambda c: F.count_if(F.col(c) == F.col(expected))
    n = F.count("*")
    return rollup_all(rows, by, [n.alias("total"), hit(before).alias("pre_correct"), hit(after).alias("post_correct"), ratio(hit(before), n).alias("pre_accuracy"), ratio(hit(after), n).alias("post_accuracy"), (ratio(hit(after), n) - ratio(hit(before), n)).alias("delta_accuracy")])


def intervention_table(rows: DataFrame, by: str, before: str, after: str, triggered: str, used: str) -> DataFrame:
    b, a, t, u = F.col(before), F.col(after), F.coalesce(triggered, F.lit(False)), F.coalesce(used, F.lit(False))
    counts = {"llm_triggered": t, "llm_used": u, "verdict_changed": b != a, "changed_to_neutral": (b != a) & (a == "neutral"), "changed_from_neutral": (b != a) & (b == "neutral"), "triggered_but_not_used": t & ~u}
    return rollup_all(rows, by, [F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in counts.items()]])


def transition_table(rows: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Counts of value combinations in each group, and over all groups."""
    each = rows.groupBy(by, *cols).agg(F.count("*").alias("n"))
    whole = each.groupBy(*cols).agg(F.sum("n").alias("n")).select(F.lit("all").alias(by), *cols, "n")
    return each.unionByName(whole)


def binary_counts(expected: Column, predicted: Column, positive: str = "support", negative: str | None = "refute") -> list[Column]:
    """tp, tn, fp, fn. A true negative is `negative` predicted and expected, or, with None, anything but positive for both."""
    e, p = expected == positive, predicted == positive
    tn = (~e & (predicted == negative) & (expected == negative)) if negative else (~e & ~p)
    return [F.count_if(e & p).alias("tp"), F.count_if(tn).alias("tn"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn")]


def at_ranks(values: DataFrame, ranks: list[int], most: int = 100_000) -> list[float]:
    """The values of a one-column table of doubles without nulls at given ranks from 0, in ascending order of values; exact.

    Each round counts what lies below and at two approximate quantiles around a rank, and goes on between them, until the
    values are equal or at most `most` are left, which are sorted. Rounds are aggregates over all tasks; collected are
    counts and what is left.
    """
    (name,) = values.columns
    v, found = F.col(name), {}
    for rank in sorted(set(ranks)):
        left, below = values, 0
        while rank not in found:
            n = left.count()
            if n <= most:
                found[rank] = sorted(r[0] for r in left.collect())[rank - below]
                break
            share = (rank - below) / n
            low, high = left.agg(F.percentile_approx(v, [max(0.0, share - 0.01), min(1.0, share + 0.01)], 1000)).first()[0]
            under, at_low, inside, at_high = left.agg(F.count_if(v < low), F.count_if(v == low), F.count_if((v > low) & (v < high)), F.count_if((v == high) & (v > low))).first()
            k = rank - below - under
            if k < 0:
                left = left.where(v < low)
            elif k < at_low:
                found[rank] = low
            elif k < at_low + inside:
                left, below = left.where((v > low) & (v < high)), below + under + at_low
            elif k < at_low + inside + at_high:
                found[rank] = high
            else:
                left, below = left.where(v > high), below + under + at_low + inside + at_high
    return [found[r] for r in ranks]


def exact_median(rows: DataFrame, column: str) -> float | None:
    """The median over all rows, the mean of the two middle values of an even number; nulls aside, null without any value."""
    values = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    n = values.count()
    if not n:
        return None
    a, b = at_ranks(values, [(n - 1) // 2, n // 2])
    return a + (b - a) / 2 if a != b else a


def run_metrics(rows: DataFrame, expected: str, predicted: str, confidence: str, seconds: str, blocked: str) -> DataFrame:
    """One row: counts, accuracy over unblocked rows and over all, neutral rate, mean confidence, mean and median latency, tp..fn.
    The median is found by selection before, in jobs of its own, so that no task gathers all rows' latencies."""
    e, p = F.col(expected), F.col(predicted)
    free, n = ~F.col(blocked), F.count("*")
    median = F.lit(exact_median(rows, seconds)).cast("double")
    return rows.agg(
        n.alias("total"), F.count_if(F.col(blocked)).alias("n_blocked"), ratio(F.count_if(free & (e == p)), F.count_if(free)).alias("accuracy"), ratio(F.count_if(e == p), n).alias("raw_accuracy"),
        ratio(F.count_if((free & (e == p)) | (F.col(blocked) & (e == "neutral"))), n).alias("blocked_adjusted"), ratio(F.count_if(p == "neutral"), n).alias("neutral_rate"),
        F.round(F.avg(confidence), 6).alias("mean_confidence"), F.round(F.avg(seconds), 6).alias("mean_seconds"), F.round(median, 6).alias("median_seconds"), *binary_counts(e, p),
    )


def support_metrics(rows: DataFrame, by: list[str], expected: str, predicted: str, digits: int = 3) -> DataFrame:
    """Accuracy, precision, recall and F1 of support, false-positive rate over support and refute rows, neutral precision and recall; half-even."""
    e, p = F.col(expected), F.col(predicted)
    tp, fp, fn = (F.count_if(x) for x in ((e == "support") & (p == "support"), (e != "support") & (p == "support"), (e == "support") & (p != "support")))
    prec, rec = ratio(tp, tp + fp), ratio(tp, tp + fn)
    ntp, np_, ne = F.count_if((e == "neutral") & (p == "neutral")), F.count_if(p == "neutral"), F.count_if(e == "neutral")
    r = lambda c, name: F.bround(c, digits).alias(name)
    aggs = [F.count("*").alias("total"), r(ratio(F.count_if(e == p), F.count("*")), "accuracy"), *binary_counts(e, p, negative=None), r(prec, "precision"), r(rec, "recall"), r(F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0), "f1"), r(ratio(fp, F.count_if(e.isin("support", "refute"))), "fpr"), r(ratio(ntp, np_), "neutral_precision"), r(ratio(ntp, ne), "neutral_recall")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def confusion(rows: DataFrame, expected: str, predicted: str, labels: list[str], by: str | None = None) -> DataFrame:
    """Counts of expected x predicted with the zeros: a grid of the few labels, left joined to the counts."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"`{expected}` string, `{predicted}` string")
    keys = [expected, predicted]
    if by:
        grid, keys = rows.select(by).distinct().crossJoin(F.broadcast(grid)), [by, *keys]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return grid.join(counts, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_metrics(rows: DataFrame, expected: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro precision, recall and F1, and F1 weighted by support, over the labels that occur on either side."""
    by = by or []
    cells = rows.groupBy(*by, expected, predicted).agg(F.count("*").alias("n"))
    one = cells.select(*by, F.explode(F.array(F.struct(F.col(expected).alias("label"), F.lit(1).alias("e"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("e"), F.lit(1).alias("p")))).alias("x"), "n", (F.col(expected) == F.col(predicted)).alias("hit"))
    per = one.groupBy(*by, F.col("x.label").alias("label")).agg(F.sum(F.col("n") * F.col("x.e")).alias("support"), F.sum(F.col("n") * F.col("x.p")).alias("called"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("x.e")).otherwise(0)).alias("tp"))
    prec, rec = ratio(F.col("tp"), F.col("called")), ratio(F.col("tp"), F.col("support"))
    per = per.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0))
    r = lambda c, n: F.round(c, 6).alias(n)
    aggs = [F.sum("support").alias("total"), r(F.sum("tp") / F.sum("support"), "accuracy"), r(F.avg("f1"), "macro_f1"), r(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), "weighted_f1"), r(F.avg("precision"), "macro_precision"), r(F.avg("recall"), "macro_recall")]
    return per.groupBy(*by).agg(*aggs) if by else per.agg(*aggs)


def ranking_metrics(rows: DataFrame, score: str, label: str) -> DataFrame:
    """roc_auc (ties count half) and average_precision, from counts per distinct score.

    Rows are summed into distinct scores first. These are parted at quantiles; sums run within a part, and what lies above
    it comes from the parts' totals, so that no task orders all of them.
    """
    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label)).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    bounds = sorted(set(rows.approxQuantile(score, [k / PARTS for k in range(1, PARTS)], 0.5 / PARTS)))
    part = F.size(F.filter(F.array(*[F.lit(float(x)) for x in bounds]), lambda x: x < F.col("s"))) if bounds else F.lit(0)
    per = per.withColumn("part", part)
    totals = per.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    over = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)  # PARTS rows at most
    totals = totals.select("part", F.coalesce(F.sum("p").over(over), F.lit(0)).alias("p"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n"))
    upto = W.partitionBy("part").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    r = per.withColumn("tp", F.sum("pos").over(upto)).withColumn("fp", F.sum("neg").over(upto)).join(F.broadcast(totals), "part")
    r = r.withColumn("tp", F.col("tp") + F.col("p")).withColumn("fp", F.col("fp") + F.col("n"))
    p, n = F.sum("pos"), F.sum("neg")
    above = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") * 0.5))
    ap = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return r.agg(p.alias("n_pos"), n.alias("n_neg"), F.round(above / (p * n), 6).alias("roc_auc"), F.round(ap / p, 6).alias("average_precision"))


def threshold_sweep(rows: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 at each threshold, from one pass over the rows."""
    s, y = F.col(score), F.col(label) == 1
    aggs = [F.struct(F.lit(t).alias("threshold"), F.count_if((s >= t) & y).alias("tp"), F.count_if((s >= t) & ~y).alias("fp"), F.count_if((s < t) & y).alias("fn")) for t in thresholds]
    out = rows.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return out.select("threshold", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def stage_timings(rows: DataFrame, stage: str, seconds: str, skip: str = "total") -> DataFrame:
    """stage, seconds, share of all, dominant: whether it is the longest but for `skip`."""
    per = rows.groupBy(stage).agg(F.sum(F.col(seconds).cast("decimal(30,12)")).cast("double").alias("seconds"))
    top = per.where(F.col(stage) != skip).agg(F.max(F.struct("seconds", stage)).alias("m"))
    whole = per.where(F.col(stage) != skip).agg(F.sum("seconds").alias("_all"))
    out = per.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(whole))
    return out.select(stage, F.round("seconds", 6).alias("seconds"), F.round(F.when(F.col(stage) != skip, F.col("seconds") / F.col("_all")), 6).alias("share"), (F.col("m")[stage] == F.col(stage)).alias("dominant"))


def unpivot_mean(rows: DataFrame, by: str, cols: dict[str, str]) -> DataFrame:
    """by, phase, mean: the mean of each of cols (phase by column)."""
    long = rows.select(by, F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(c).alias("v")) for c, p in cols.items()])).alias("x")).select(by, "x.*")
    return long.groupBy(by, "phase").agg(F.round(F.avg("v"), 6).alias("mean"))


def compare_runs(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """a and b side by side over the union of their keys, with the difference."""
    x, y = a.select(*keys, F.col(value).alias("value_a")), b.select(*keys, F.col(value).alias("value_b"))
    return x.join(y, keys, "full_outer").withColumn("delta", F.col("value_b") - F.col("value_a"))


def in_order(rows: DataFrame, order: list[str], key: str) -> DataFrame:
    """rows for each of `order`, with its place; missing ones are null."""
    dim = rows.sparkSession.createDataFrame(list(enumerate(order, 1)), f"place int, `{key}` string")
    return dim.join(rows, key, "left")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def first_drop_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that a row fails, `kept` if none."""
    return reduce(lambda x, kv: F.when(kv[1], kv[0]).otherwise(x), reversed(checks), F.lit("kept"))


def expected_recall(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """rows with n_expected, n_found, recall of a list of URLs, by lower-cased distinct ones."""
    low = lambda c: F.array_distinct(F.transform(c, F.lower))
    n, k = F.size(low(expected)), F.size(F.array_intersect(low(expected), low(got)))
    return rows.withColumn("n_expected", n).withColumn("n_found", k).withColumn("recall", ratio(k, n))
