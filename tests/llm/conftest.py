import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, n int, rep long"

#: Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank.\nSecond line here, rather short.", "en", "a", 90, "x", 1, 1),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank!\nAnother second line of its own kind.", "en", "a", 91, "x", 1, 1),
    (3, "The quick brown fox jumps over the lazy dog near the old river bank.\nSecond line here, rather short.", "en", "b", 90, None, None, None),
    (3, "The quick brown fox jumps over the lazy dog near the old river bank.\nSecond line here, rather short.", "en", "b", 90, None, None, None),
    (4, None, None, None, None, None, None, None),
    (5, "", "en", "b", 0, "x", 1, 1),
    (6, " \n\t\r\n ", "en", "b", 5, "x", 1, 1),
    (None, "A text without an id that mentions jane.doe42@mail.example.com and +1 (555) 123-4567 twice: jane.doe42@mail.example.com.", "en", "c", 9, "x", 1, 1),
    (7, "one two", "en", None, 7, "x", 1, 1),
    (8, "One Two", "en", None, 7, "x", 1, 1),
    (9, " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000)), "en", "c", 400_000, "x", 1, 1),
    (10, " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000)) + " end", "en", "c", 400_000, "x", 1, 1),
    (11, "naïve façade — été 10.0.0.1 日本語 text\nLicensed under the Apache License, Version 2.0.", "fr", "d", 30, "x", 1, 1),
    (12, "Mr. John Smith met Mrs. Anna Smith; Mr. John Smith paid 4111 1111 1111 1111 from 203.0.113.9.", "en", "d", 30, "x", 1, 1),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf01():
    return "/root/testdata/sf0.01"
