import pytest

from assayer.llm.ship import ship

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BASE = " ".join(f"word{i}" for i in range(120))


@pytest.fixture(scope="module")
def shipped(spark):
    return ship(spark)


@pytest.fixture(scope="module")
def odd_docs(shipped):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and columns with the names of results."""
    rows = [
        (1, BASE, "en", "a", 1), (2, BASE.replace(" ", "\t\n"), "en", "a", 1), (3, BASE + " extra", None, None, None),
        (4, None, None, "b", 0), (5, "", "en", None, 0), (6, "  \n ", "de", "b", 3), (7, "word " * 60_000, "en", "a", 1),
        (None, BASE, "en", "a", 1), (8, "short text", "de", "b", 10), (8, "short text", "de", "b", 10), (9, "123 !!! ...", "de", "b", 9),
        (10, "é ü ß Straße naïve 日本語", "de", "b", 9),
    ]
    docs = shipped.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    clash = {c: F.lit("x") for c in ("kept", "score", "tokens", "node", "class", "sampled", "sha", "maybe", "text_sha256")}
    return docs.withColumns(clash)


@pytest.fixture(scope="module")
def no_docs(shipped):
    return shipped.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(shipped, sf_dir):
    return shipped.read.parquet(f"{sf_dir}/documents.parquet")
