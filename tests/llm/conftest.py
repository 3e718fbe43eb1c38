import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, row_hash string, k1 string, group_size string, u int, size int"
LONG = "word and other " * 20_000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, "Alpha beta gamma delta epsilon.", "en", "a"), (2, "Alpha  beta gamma\ndelta epsilon.", "en", "a"), (2, "Alpha  beta gamma\ndelta epsilon.", "en", "a"), (3, None, None, None), (None, "x y", "en", "b"), (None, None, None, None),
            (4, "", "en", "a"), (5, "   \n", "en", "b"), (6, LONG, "en", "b"), (7, LONG + "z", "en", "c"), (8, "日本語 テキスト 😀 é", None, "ä")]
    return spark.createDataFrame([(*r, 1, 0, "h", "k", "g", 1, 2) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
