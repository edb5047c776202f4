import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with every awkward shape: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i // 7}" for i in range(30000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of the other dogs in the big old town"
    rows = [
        (1, base, "en", "b", 5), (2, base, "en", "a", 5), (3, base.upper(), "en", "a", 1), (4, base + " now", "en", None, 1), (5, None, None, None, None), (6, "", "en", "a", 0), (7, " \n\t", "en", "b", 0),
        (8, long, "en", "b", 9), (9, long + " end", "en", "a", 9), (None, "no id here", "en", "a", 1), (10, "short", "xx", "", 1), (10, "short", "xx", "", 1), (11, "a b", "xx", "z", 1), (12, "é ß 中文 😀 слово", "xx", "é", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as hash", "1 as n", "2 as node", "3 as key", "4 as size", "5 as block", "6 as h")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.filter("doc_id = -1")
