import pytest

CLASH = "id long, key long, fp long, part long, row long, tie long, n long, size long, count long, _s string, word string"


@pytest.fixture()
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with clashing names."""
    long_text = " ".join(f"w{i * i % 977}" for i in range(30_000))
    same = (5, "one two three four five six", "en", "b", 27)
    rows = [(1, None, None, None, None), (None, "alpha beta gamma", "en", "a", 16), (2, "", "en", "a", 0), (3, " \t\n", "de", "", 3),
            (4, long_text, "en", "b", len(long_text)), same, same, (6, "ONE two\nthree four five SIX", "en", "b", 27),
            (7, "é ñ ß 日本語 🙂", None, "c", 13), (8, "x", "en", None, 1)]
    extra = (9, 9, 9, 9, 9, 9, 9, 9, 9, "z", "z")
    return spark.createDataFrame([r + extra for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
