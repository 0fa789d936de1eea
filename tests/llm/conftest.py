from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from testimony.llm.queries import on_workers  # noqa: E402


@pytest.fixture(scope="session")
def llm(spark):
    on_workers(spark)
    return spark


@pytest.fixture
def docs_of(llm):
    """Documents with nulls, an empty and a long text, repeated rows and columns whose names operators use inside."""

    def make(*texts, extra=True):
        rows = [(i, t, "did", 1.5, "x") for i, t in enumerate(texts)]
        schema = "doc_id long, text string, th string, n_words double, uid string"
        frame = llm.createDataFrame(rows, schema)
        if extra:
            frame = frame.union(llm.createDataFrame([(None, None, None, None, None), (None, "no id at all", None, None, None)], schema))
        return frame.repartition(3)

    return make


ODD = [None, "", " \n\t ", "\n\n", "é", "word", "Two words", "a" * 5000, "x y z " * 3000, "nul \x00 byte \x0b vt \x0c ff \r\n end", "日本語の文章です。空白なし" * 50]
