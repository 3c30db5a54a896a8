import pytest


@pytest.fixture
def documents(spark):
    def make(rows, extra=()):
        """(doc_id, text) rows as a documents table, with other columns whose names might clash."""
        return spark.createDataFrame([(*r, "en", "src0", len(r[1] or ""), 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, n long, rank int")

    return make
