import pytest

# Rows every operator on documents must take: no text, no id, empty, blank, repeated, long, and columns it does not know.
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. Mail a.b@mail.example.com now.", "en"),
    (1, "The quick brown fox jumps over the lazy dog. Mail a.b@mail.example.com now.", "en"),
    (2, None, "en"), (3, "", None), (4, "  \n\t ", "de"), (None, "und der die das nicht ist", "de"), (None, None, None),
    (5, "x" * 70_000, "en"), (6, "wort " * 30_000, "de"), (7, "!!! ### 123", None), (2**53 + 1, "日本 👍 é", "fr"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, lang, "s", None if t is None else len(t), 1.5, "clash") for i, t, lang in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string")


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return spark.createDataFrame([], awkward.schema)
