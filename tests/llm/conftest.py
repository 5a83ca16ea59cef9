import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string, bucket_ string"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    prose = "the quick brown fox jumps over the lazy dog while many people look on and cheer loudly today"
    rows = [
        (1, prose, "en", "a", 1, "x", None),
        (2, prose, "en", "a", 1, None, "y"),
        (2, prose, "en", "a", 1, None, "y"),
        (3, "", "de", "b", 0, None, None),
        (4, None, None, None, None, None, None),
        (None, "one two", "fr", None, 7, None, None),
        (None, None, None, None, None, None, None),
        (5, LONG, "en", "b", len(LONG), None, None),
        (6, " \t\n ", "en", "c", 4, None, None),
        (7, "Ünï cödé 中文 \U0001f600 \x00 end", None, "c", 9, None, None),
        (8, prose.upper() + "\n" + prose + "\n" + prose, "en", "a", 3, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
