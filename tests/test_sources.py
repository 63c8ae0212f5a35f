import json

import pytest
from pyspark.sql import functions as F

from claimloom.sources import readers as R


def test_jsonl_and_cases(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r.id for r in R.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int").collect() if r.id) == [1, 2]
    rows = [{"id": "x", "claim": "c"}]
    for k, body in enumerate((rows, {"claims": rows}, {"cases": rows})):
        (tmp_path / f"{k}.json").write_text("﻿" + json.dumps(body), encoding="utf-8")
        assert [tuple(r) for r in R.read_cases(spark, str(tmp_path / f"{k}.json"), "id string, claim string").collect()] == [("x", "c")]
    (tmp_path / "bad.json").write_text('{"other": []}')
    with pytest.raises(Exception, match="no rows"):
        R.read_cases(spark, str(tmp_path / "bad.json"), "id string").collect()


def test_js_array(spark, tmp_path):
    (tmp_path / "x.html").write_text('<script>const DATA = [{id: 1, claim: "a"},{id: 2, claim: "b"},];</script>')
    assert [tuple(r) for r in R.read_js_array(spark, str(tmp_path / "x.html"), "DATA", "id int, claim string").collect()] == [(1, "a"), (2, "b")]


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,ok,v\n1,True,0.5\n2,x,n/a\n")
    (tmp_path / "b.csv").write_text("id,v\n3,1\n")
    d = R.read_csvs(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], {"id": "int", "ok": "boolean", "v": "double"})
    assert sorted(map(tuple, d.collect()), key=str) == sorted([(1, True, 0.5), (2, None, None), (3, None, 1.0)], key=str)
    R.write_csv(d, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_folders(spark, tmp_path):
    for lang in ("hi", "ta"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / "snap" / lang / "train"))
    got = R.read_by_language(spark, str(tmp_path / "snap")).groupBy("lang", "split").count().collect()
    assert sorted(map(tuple, got)) == [("hi", "train", 3), ("ta", "train", 3)]
    R.write_sorted(spark.range(10).withColumn("language", F.when(F.col("id") < 5, "a").otherwise("b")), str(tmp_path / "by"), "language", "id")
    assert len(list((tmp_path / "by" / "language=a").glob("*.json"))) == 1
    R.write_splits(spark.range(4).withColumn("split", F.lit("train")), str(tmp_path / "splits"))
    R.write_record(spark.range(1), str(tmp_path / "latest"), str(tmp_path / "runs"))
    R.write_record(spark.range(1), str(tmp_path / "latest"), str(tmp_path / "runs"))
    assert (spark.read.json(str(tmp_path / "latest")).count(), spark.read.json(str(tmp_path / "runs")).count()) == (1, 2)


def test_binary_and_slot(spark, tmp_path):
    (tmp_path / "i.png").write_bytes(b"abc")
    assert [(r.length, bytes(r.content)) for r in R.read_binary(spark, str(tmp_path), "*.png").collect()] == [(3, b"abc")]
    d = spark.createDataFrame([("ab",), (None,)], "t string")
    assert sorted(r[0] for r in d.select(R.slot(lambda c: c.str.len().astype("int64"), "long")("t")).collect()) == [0, 2]


def test_page_specs(spark):
    cases = {"1-3": [1, 2, 3], "3-1": [1, 2, 3], "2": [2], "9": [], "1,2-3, 2": [1, 2, 3], "x": [], "": [1, 2, 3, 4]}
    for spec, want in cases.items():
        assert R.read_pages_spec(spec, 4) == want
        got = spark.createDataFrame([(spec,)], "s string").select(F.sort_array(R.page_spec(F.col("s"), F.lit(4)))).first()[0]
        assert got == (want if spec else [])
    assert R.read_pages_spec("", 9, 2) == [1, 2]


def test_ocr_rows(spark, tmp_path):
    """The main engine's reading if it is sure enough, else the surer one's; images only, unreadable ones too."""
    for name, data in {"a.png": b"main", "sub/b.JPG": b"other", "c.jpg": b"none", "d.txt": b"main"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)

    def main():
        return lambda images: [[("one", 90), ("two", 80), ("x", -1), (" ", 70)] if i == b"main" else [("one", 50)] if i == b"other" else None for i in images]

    def second():
        return lambda images: [[("eins", 60)] if i != b"none" else [] for i in images]

    got = {r.path.rsplit("/", 1)[1]: (r.engine, r.text, round(r.confidence, 3), len(r.words)) for r in R.ocr_rows(spark, str(tmp_path), {"main": main, "second": second}, "main").collect()}
    assert got == {"a.png": ("main", "one two", 0.8, 3), "b.JPG": ("second", "eins", 0.6, 1), "c.jpg": ("main", "", 0.0, 0)}


def test_labelled_rows(spark):
    d = spark.createDataFrame([(k, str(k % 4)) for k in range(40)], "id int, label string")
    table = {"0": "neutral", "1": "support", "2": "refute"}
    got = R.read_labelled(d, "label", table, most=4)
    assert {r.label: r["count"] for r in got.groupBy("label").count().collect()} == {"neutral": 4, "support": 4, "refute": 4}
    assert sorted(got.collect()) == sorted(R.read_labelled(d.repartition(7), "label", table, most=4).collect()) and R.read_labelled(d, "label", table).count() == 30
