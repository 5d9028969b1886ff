from __future__ import annotations

import pytest

LONG = "a very long text about nothing in particular " * 4000
EDGE = [
    (1, None), (2, ""), (3, "   \t\n"), (4, "One word"), (5, "one WORD"), (6, "one WORD"), (7, LONG), (8, LONG + "!"), (9, "Ünïcödé \U0001f600 text, ÄÖÜ"),
    (10, "ünïcödé \U0001f600 text, ÄÖÜ"), (11, "<|endoftext|> inside"), (12, "x"), (12, "x"), (None, "no id"), (None, "x"), (13, "1234567890 --- !!!"), (14, "▁mark ▁ and  two  spaces ﷐"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    rows = [(i, t, None, "s", len(t or ""), i, "k", 1, 2.0, "fp") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, h long, k1 string, piece int, score double, `a.b` string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
