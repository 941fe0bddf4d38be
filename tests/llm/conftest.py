import os

import pytest

pytest.importorskip("sigloom.llm")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, None), (3, "a b c", "fr", "s", 5), (4, "one two three four five six seven " * 400, "en", "s", 1),
        (5, "one two three four five six seven " * 400, "en", "s", 1), (5, "one two three four five six seven " * 400, "en", "s", 1), (None, "one two three four five six seven", "en", None, 2),
        (7, "x" * 50_000, "de", "s", 3), (8, "\n\n \t\n", "es", "s", 4), (9, "Zeile eins ist lang genug hier\nzwei", "de", "s", 2), (10, "zeile eins ist lang genug hier \nÉcole", "de", "s", 2),
        (11, "  ZEILE EINS IST LANG GENUG HIER\r\n", "de", "s", 2), (12, "日本語のテキスト 🎉 password: hunter22", "en", "s", 9), (-3, "A", "en", "s", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    return df.selectExpr("*", "doc_id as component_id", "text as spans", "1 as `group`", "lang as drop", "2 as slot", "text as host", "doc_id as node", "'x' as score", "3 as `a.b`")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
