"""A job that is stopped between and within batches ends with each row once."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.sources import resume as R

ROW = "id int, split string, lang string, text string"


def files(folder, ids):
    folder.mkdir(exist_ok=True)
    for k in ids:
        rows = [{"id": 10 * k + i, "split": "train" if k % 2 else "val", "lang": "hi" if i % 2 else "ta", "text": f"row {k} {i}"} for i in range(10)]
        (folder / f"{k:03}.json").write_text("\n".join(map(json.dumps, rows)))


@pytest.mark.parametrize("where", ["before", "after"])
def test_stopped_jobs_go_on(spark, tmp_path, where):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    files(source, range(6))
    made = []

    def make(rows, fail_at=None):
        d = rows.withColumn("text", F.upper("text"))
        made.append(d.count())
        if len(made) == fail_at:
            if where == "after":  # the rows are written, but the batch is not noted as done
                d.write.mode("overwrite").parquet(f"{out}/batch={fail_at - 1}")
            raise RuntimeError("stopped")
        return d

    with pytest.raises(Exception, match="stopped"):
        R.run_resumable(spark, str(source), ROW, out, checkpoint, lambda r: make(r, 3), files=1)
    assert made == [10, 10, 10]
    R.run_resumable(spark, str(source), ROW, out, checkpoint, make, files=1)
    assert made == [10] * 7  # the third batch again, then the other three
    rows = R.written(spark, out, ROW)
    assert sorted((r.id, r.text) for r in rows.collect()) == [(10 * k + i, f"ROW {k} {i}") for k in range(6) for i in range(10)]
    assert sorted(map(tuple, R.progress(rows, key="id").collect())) == [("train", "hi", 15, 59), ("train", "ta", 15, 58), ("val", "hi", 15, 49), ("val", "ta", 15, 48)]

    R.run_resumable(spark, str(source), ROW, out, checkpoint, make)
    assert len(made) == 7
    files(source, [6])
    R.run_resumable(spark, str(source), ROW, out, checkpoint, make)
    assert made[7:] == [10] and R.written(spark, out, ROW).count() == 70
