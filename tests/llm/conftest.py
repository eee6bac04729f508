import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, row string, words string, "
          "h string, block string, ids string, fp string, score string, start string")


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from ``{id: text}`` or ``(id, text[, lang[, source]])`` rows, with extra columns of clashing names."""
    def make(rows):
        rows = list(rows.items()) if isinstance(rows, dict) else rows
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(i, t, lang, src, None, *("x",) * 9) for i, t, lang, src in full], SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, blanks, repeated rows, a row without id, signs only, and a very long text without any blank."""
    return docs([(1, None), (2, ""), (3, " \n\t "), (4, "one word"), (4, "one word"), (None, "no id here"),
                 (5, "x" * 200_000), (6, "!? --- ..."), (7, "é́ \U0001f600 İ ẞ"), (8, "ab " * 30_000, "en", "s")])


@pytest.fixture(scope="session")
def none(docs):
    return docs([])
