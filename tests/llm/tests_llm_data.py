"""Rows that the operators' tests share."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, spans string"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, columns named as results."""
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [
        (1, "", "en", "a", 0, 1, "x"), (2, None, "de", "a", None, 2, None), (3, "\n\t ", None, None, 3, None, "x"),
        (4, "42 % !!", "en", "b", 7, 4, "x"), (5, "x" * 100_000, "en", "b", 1, 5, "x"), (6, long, "de", "c", 1, 6, "x"),
        (7, long + "sic", None, "c", 1, 7, "x"), (None, "a text without an id", "en", None, 1, 8, "x"), (None, None, None, None, None, None, None),
        (20, "one two three four five six", "en", "d", 1, 9, "x"), (21, "One  two three FOUR five six", "en", "d", 1, 9, "x"),
        (30, "the very same row", "fr", "e", 1, 9, "x"), (30, "the very same row", "fr", "e", 1, 9, "x"),
        (40, "Привет мир это текст", "ru", "é", 1, 9, "x"), (41, "emoji 😀 token = 'abcdefgh12345'", "en", "z", 1, 9, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
