"""Every registered query against its SQL; those without one give rows with a stable schema."""

import re

import pytest

from claimloom import queries as q
from claimloom import queries_more, queries_rest  # noqa: F401
from tests.conftest import same

#: Queries whose rule rejects or keeps nothing on the small table.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_equals_sql(spark, duck, sf, name):
    assert same(q.QUERIES[name](spark, sf), duck, q.SQL[name]) > 0 or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_gives_rows(spark, sf, name):
    d = q.QUERIES[name](spark, sf)
    assert d.count() > 0 and d.schema == q.QUERIES[name](spark, sf).schema


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_no_other_module_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(q.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in [w for line in p.read_text().splitlines() if "import" in line for w in line.replace(".", " ").split()]


def test_anchors_of_whole_texts(spark, sf, tmp_path):
    """Against the rule in plain Python, also past 400 characters."""

    def plain(text):
        out = {}
        for x in re.findall(r"[A-Za-z][A-Za-z0-9._/-]*|\d+(?:[.,]\d+)?(?:%|[A-Za-z]+)?", text or ""):
            if len(x) >= 2:
                out.setdefault(x.lower(), x)
        return " ".join(list(out.values())[:10])

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [None, "", "a b 5", "भारत " * 200 + "GDP gdp 7.5% Gdp 12kg v1.2/x-y ३४ 1,000,000", " ".join(f"W{k % 12} w{k % 12}" for k in range(400))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.anchors for r in q.QUERIES["f20_anchors"](spark, str(tmp_path)).collect()}
    assert got == {k: plain(x) for k, x in enumerate(texts)}


def test_every_vector_has_a_relevance(spark, sf):
    ids = [r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r.vec_id for r in q.QUERIES["s2_embedding_relevance"](spark, sf).collect()) == sorted(ids)
