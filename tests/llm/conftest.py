import pytest

ROW = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties and repeated rows, and a column that no operator knows."""
    rows = [
        (1, "The token = \"abcDEF123456\" stays. Released under the MIT License.", "en", "a", 60, "x"),
        (2, None, None, None, None, None),
        (3, "", "en", "a", 0, ""),
        (4, "   \t\n ", "fr", "b", 6, "y"),
        (5, "one two three", "en", "b", 13, "y"),
        (6, "One TWO three", "en", None, 13, "y"),
        (7, "word " * 30000, "de", "a", 150000, "z"),
        (7, "word " * 30000, "de", "a", 150000, "z"),
        (8, "12345 !!! ...", None, "b", 13, "z"),
        (9, "x" * 5000, "de", "c", 5000, "z"),
        (10, "Ünïcode ﬁ İstanbul 日本語 😀", "de", "c", 22, "z"),
        (None, "a text of a row without any id", "en", "c", 30, None),
    ]
    return spark.createDataFrame(rows, ROW)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ROW)


@pytest.fixture(scope="session")
def tables(spark, odd, empty, tmp_path_factory):
    """Folders with such tables, for the queries."""
    out = {}
    for name, d in (("odd", odd), ("empty", empty)):
        at = tmp_path_factory.mktemp(name)
        d.write.parquet(str(at / "documents.parquet"))
        pages = [(1, "https://h.org/a", "<html><body><nav>n</nav><article><p>A<p>B &amp; C</article></body>"), (2, None, None), (3, "", ""), (3, "", ""), (None, "x", "<p>" * 3000 + "deep"), (5, "https://h.org/b", "plain text <unclosed")]
        vectors = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0]), (7, [0.5, 0.5]), (200, [0.0, 1.0]), (200, [0.0, 1.0]), (None, [1.0, 1.0]), (8, [])]
        spark.createDataFrame(pages if name == "odd" else [], "page_id long, url string, html string").write.parquet(str(at / "pages.parquet"))
        vectors = [(i, v, None if i == 7 else (i or 0) % 3) for i, v in vectors]
        spark.createDataFrame(vectors if name == "odd" else [], "vec_id long, embedding array<float>, label int").write.parquet(str(at / "embeddings.parquet"))
        lines = [(1, 1, 5, 2, 6.0), (1, 1, 5, 2, 6.0), (1, None, 6, 3, 9.1), (2, 1, 6, -2, -5.0), (2, 2, 7, 0, 1.0), (None, 1, 7, 1, 3.0), (3, 1, None, 1, 3.0), (3, 2, 7, 1, None), (3, 3, 7, None, 3.0), (4, 1, 7, 1, float("nan")), (4, 2, 7, 1, 1e300), (5, 1, 8, 1, -3.0), (6, 1, 9, 7, 20000.0)]
        items = [(5, 3.0), (5, 3.0), (6, 3.1), (7, None), (8, -3.2), (9, 2860.0), (None, 3.0), (10, float("inf")), (11, 0.0)]
        spark.createDataFrame(lines if name == "odd" else [], "sale_id long, line_no int, item_id long, quantity int, amount double").write.parquet(str(at / "sale_lines.parquet"))
        spark.createDataFrame(items if name == "odd" else [], "item_id long, price double").write.parquet(str(at / "items.parquet"))
        out[name] = str(at)
    return out
