import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with inner ones."""
    clashing = ("group", "keys", "component", "x", "h", "size", "rows", "z", "toxic_", "bin", "metric", "digest", "__places", "sections", "words")

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), 7, *range(len(clashing))) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n long" + "".join(f", `{c}` int" for c in clashing))

    return make
