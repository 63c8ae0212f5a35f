"""Every operator and stage on odd and on empty tables."""

import pytest

import corpus_pipeline as P
from claimloom.llm.queries import QUERIES, SQL
from tests.conftest import same
from tests.llm.test_joins import plain_band


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, tables, name):
    got = QUERIES[name](spark, tables["odd"]).collect()
    if name.startswith("op7_"):
        assert sorted((r.page_id is None, r.text) for r in got) == sorted([(False, "A B & C"), (False, ""), (False, ""), (False, ""), (True, "deep"), (False, "plain text")])
    elif name.startswith("op10_"):
        assert {(r.query_id, r["rank"]): r.vec_id for r in got if r.query_id != 200} == {(0, 1): 100, (0, 2): 1, (0, 3): 7, (0, 4): 200, (0, 5): 200, (100, 1): 0, (100, 2): 1, (100, 3): 7, (100, 4): 200, (100, 5): 200}
    elif name.startswith("op11_"):
        assert sorted(map(tuple, got)) == [(200, 200, 1, 1, 65536, 32768)] * 2
    elif name.startswith("op12_"):
        assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(0, 9004, "response", None), (1, 66, "response", None), (2, 0, "response", None), (3, 0, "revisit", 2), (3, 0, "revisit", 2), (5, 20, "response", None)]
    elif name.startswith("op13_"):
        assert sorted(map(str, got)) == sorted(map(str, plain_band(tables["odd"])))
    else:
        assert len(got) == 12


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table(spark, tables, name):
    assert QUERIES[name](spark, tables["empty"]).count() == 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, sf, name):
    assert same(QUERIES[name](spark, sf), duck, SQL[name]) > 0


def test_stages_on_odd_and_empty(spark, odd, empty, tables):
    for docs in (empty, odd):
        d = docs
        for k, (_, f) in enumerate(P.STAGES):
            out = f(spark, d, tables["odd"])
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns
            else:
                assert out.count() == (0 if docs is empty else out.count())
            d = P.stage(out, "test")
    first = P.identify_language(spark, odd, "")
    assert sorted((r.doc_id or 0) for r in first.collect()) == [0, 1, 5, 6, 7, 7, 9, 10]
    second = P.drop_near_duplicates(spark, first, "")
    assert sorted((r.doc_id or 0) for r in second.collect()) == [0, 1, 5, 7, 9, 10]
    third = {r.doc_id: r for r in P.mask_secrets(spark, second, "").collect()}
    assert third[1].text.startswith("The <secret>") and third[1].n_chars == len(third[1].text) and third[5].text == "one two three"
    assert sorted(third, key=lambda x: x or 0) == [None, 1, 5, 7, 9, 10]


def test_clashing_columns(spark, odd, tables):
    names = ["_row", "spans", "found", "size", "copies", "copy", "score", "lang_pred", "n_live", "source_size", "_source", "rate", "a", "b", "node"]
    d = odd.select("*", *[odd.doc_id.alias(n) for n in names]).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    for _, f in P.STAGES[:-1]:
        d = P.stage(f(spark, d, tables["odd"]), "clash")
        assert d.columns == [*odd.columns, *names] and d.where("NOT (_row <=> doc_id AND spans <=> doc_id AND copies <=> doc_id)").isEmpty()
    assert P.STAGES[-1][1](spark, d, tables["odd"]).count() == d.count() > 0


def test_pipeline_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = P.identify_language(spark, docs, sf)
    assert first.count() == docs.where("text rlike '[a-zA-Z]'").count()
    out = P.run(spark, sf)
    kept = QUERIES["op2_near_dedup"](spark, sf).where("kept").select("doc_id")
    assert out.select("doc_id").distinct().join(kept, "doc_id", "left_anti").count() == 0
    assert P.run(spark, sf).exceptAll(out).count() == 0
