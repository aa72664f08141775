from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_schema() -> str:
    return "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


@pytest.fixture
def make_docs(spark, docs_schema):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, docs_schema)

    return make
