import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, ties, and columns whose names clash."""
    long = " ".join(f"word{i % 97} of{i % 11}" for i in range(20_000))
    rows = [(1, "Same text of the day, twice here."), (1, "Same text of the day, twice here."), (2, None), (3, ""), (4, " \n\t "), (None, "a text without an id, but words"), (5, long), (6, long), (7, "x"), (8, "%% 12 ??"), (9, "é" * 300)]
    made = [(k, t, "en" if k != 7 else None, "s", 0, "h", 1, "f", [1], True) for k, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, h string, fingerprint long, span string, ids array<int>, known boolean")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
