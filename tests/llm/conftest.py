import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, size double, __uid int, Label string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, copies, repeated rows; other columns bear the names that
    operators use inside."""
    long = "wort für wort " * 20_000
    rows = [
        (1, "The same text here and now.", "en", "a", 27, "u", 1.0, 1, "x"),
        (2, "The  same\ttext\nhere and now. ", "en", "a", 29, "u", 1.0, 1, "x"),
        (2, "The  same\ttext\nhere and now. ", "en", "a", 29, "u", 1.0, 1, "x"),
        (3, "Another text, of more than a few words, that stands alone.", "en", None, 50, None, None, None, None),
        (4, None, None, "b", None, None, None, 2, "y"),
        (5, "", "de", "b", 0, "v", 2.0, 3, "z"),
        (6, " \n\t", None, None, 3, "v", 2.0, 3, "z"),
        (None, "A row without an id.", "en", "c", 20, "w", 0.0, 4, "x"),
        (None, "A row without an id.", "en", "c", 20, "w", 0.0, 4, "x"),
        (7, long, "de", "a", len(long), "w", 0.0, 5, "x"),
        (8, long + "ende", "de", "a", len(long) + 4, "w", 0.0, 5, "x"),
        (9, "x" * 100_000, "en", "a", 100_000, "w", 0.0, 5, "x"),
        (10, "日本語 🙂 ˈfəʊ \u0000 ▁▁ <s>", "ja", "日本", 20, "w", 0.0, 5, "x"),
        (11, "1234 5678", "en", "d", 9, "w", 0.0, 6, "x"),
        (12, "The same text here and now, or nearly so it seems to us all today.", "en", "d", 60, "w", 0.0, 6, "x"),
        (13, "You are a stupid idiot and a worthless loser, you scum!", "en", "d", 55, "w", 0.0, 6, "x"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
