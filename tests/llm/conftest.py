from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table, with an extra column whose name the operators use too."""

    def make(texts, first=0):
        rows = [(k, t, "en", f"src{k % 3}", None if t is None else len(t), "clash") for k, t in enumerate(texts, first)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")

    return make
