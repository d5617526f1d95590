import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Rows of (doc_id, text[, lang, source]) as documents."""

    def make(rows, parts=3):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "a")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


#: Nulls, empty and blank texts, ties, repeated rows, letters of several alphabets, a very long text.
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "b"), (4, "one", "en", "a"), (4, "one", "en", "a"), (5, "ÀÉ ñ 日本語 😀 x y", "fr", None), (None, "no id here at all", "de", "b"), (6, "a b " * 30000, "en", "a"), (7, "123 !!! ***", "en", "c")]
