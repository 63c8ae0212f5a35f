"""Lists in JSON files of any size against json.load."""

import json
import random

import pytest

from claimloom.sources import arrays as A
from claimloom.sources.readers import read_cases

ROW = "id int, text string, more array<struct<x: string>>"


def value(rng):
    word = lambda: "".join(rng.choice(['a', "é", "😀", "{", "}", "[", "]", "\\", '"', "\n", ",", ' "claims": [', " "]) for _ in range(rng.randint(0, 12)))
    return [{"id": k, "text": word(), "more": [{"x": word()} for _ in range(rng.randint(0, 3))], "deep": {"claims": [{"id": -1, "y": [[{}], []]}]}} for k in range(rng.randint(1, 40))]


@pytest.fixture
def tiny_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("shape", ["list", "claims", "cases", "both"])
def test_equal_to_json_load(spark, tmp_path, tiny_splits, monkeypatch, shape):
    rng = random.Random(shape)
    want = []
    for f in range(4):
        rows = value(rng)
        made = {"list": rows, "claims": {"note": "} ] \"", "other": [{"id": -2}], "claims": rows}, "cases": {"cases": rows, "n": 3}, "both": {"cases": [{"id": -3}], "in": {"claims": [{"id": -4}]}, "claims": rows}}[shape]
        text = json.dumps(made, ensure_ascii=f % 2 == 0, indent=rng.choice([None, 1]))
        (tmp_path / f"{f}.json").write_bytes((b"\xef\xbb\xbf" if f % 3 == 0 else b"") + text.encode() + rng.choice([b"", b"\n", b"  \n"]))
        want += [json.dumps(x, sort_keys=True) for x in rows]
    for few in (100_000, 0):
        monkeypatch.setattr(A, "BROADCAST_SPLITS", few)
        got = A.elements(spark, str(tmp_path))
        assert sorted(json.dumps(json.loads(r.text), sort_keys=True) for r in got.collect()) == sorted(want)
    assert read_cases(spark, str(tmp_path), ROW).count() == len(want)


def test_one_large_list_is_read_by_many_tasks(spark, tmp_path, tiny_splits):
    rows = [{"id": k, "text": "x" * (5000 if k == 7 else 40)} for k in range(400)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    d = A.elements(spark, str(tmp_path / "a.json"))
    assert spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions() > 8
    assert sorted((json.loads(r.text) for r in d.collect()), key=lambda x: x["id"]) == rows


@pytest.mark.parametrize("text", ["", "3", '"text"', "{}", '{"rows": [{"id": 1}]}', "[]", '{"claims": []}', '[{"id": 1}', '[{"id": 1', '[{"id": "1}]', '[{"id": 1]}', "[{id 1}]", '{"claims": 3}', '[1, 2]'])
def test_other_and_broken_files_raise(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="a.json"):
        read_cases(spark, str(tmp_path / "a.json"), ROW).collect()


def test_states_of_strings():
    import re

    key = re.compile(r'"(k)"\s*:\s*\Z')
    text = json.dumps({"k": [{"a": 'q"\\', "b": "\\\\"}, {"c": '}"{'}]})
    for size in range(1, len(text)):
        s = A.Scanner(A.OUT, key, None, A._wanted("k"))
        got = []
        for at in range(0, len(text), size):
            got += [(at + p, b) for p, b in s.feed(text[at : at + size])]
        ends = [text[a:b] for (a, x), (b, y) in zip(got[::2], got[1::2], strict=True) if x and not y]
        assert [json.loads(e) for e in ends] == json.loads(text)["k"] and s.state == A.OUT and not s.stack, size
