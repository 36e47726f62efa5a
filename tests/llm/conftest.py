import pytest


@pytest.fixture
def docs(spark):
    """Build a documents table from ``(doc_id, text)`` or ``(doc_id, text, lang, source)`` rows."""
    def make(rows, extra=""):
        rows = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string" + extra)
    return make
