import pytest

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, n long, rep long, shard int, slot long, "
        "hash int, pos int, row long, bucket int, score double, key string, component long, _id long, _text string")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang]) as documents with extra columns whose names clash with inner ones."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) + (7, 7, 7, 7, 7, 7, 7, 7, 0.5, "k", 7, 7, "t")
                for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


AWKWARD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n", None), (4, "one", "en"), (5, "One two three", "de"),
    (6, "ü ñ 漢字 — 😀", "fr"), (7, "12 34 !!", "en"), (8, "the cat sat on the mat and the dog ran off " * 2000, "en"),
    (9, "same words in the same order every time", "en"), (10, "same words in the same order every time", "de"),
    (10, "same words in the same order every time", "de"), (None, "a row without an id has words too", "en"),
    (12, "a " * 4000, "en"),
]


@pytest.fixture(scope="session")
def awkward(make_docs):
    return make_docs(AWKWARD)


@pytest.fixture(scope="session")
def nothing(make_docs):
    return make_docs([])
