import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank today.",
    None,
    "",
    "   \t\n ",
    "one",
    "one two",
    "The quick brown fox jumps over the lazy dog near the river bank today.",
    "Mail a.b@c.example.org or +1 (555) 123-4567 from 10.0.0.1, card 4111 1111 1111 1111.",
    "é è ü ñ 日本語 \U0001f600 end",
    "word " * 5000,
    "x" * 20000,
    "1 2 3 4 5 6 7 8 9 " * 800,
    "... !!! ???",
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empties, repeats, very long texts and columns with clashing names."""
    rows = [(i if i != 4 else None, t, [None, "en", "fr"][i % 3], "s", -1, "x") for i, t in enumerate(TEXTS)]
    rows.append(rows[0])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
