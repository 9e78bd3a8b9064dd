import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """rows (doc_id, text[, source]) to a documents table with a few extra
    columns whose names clash with those of the operators' own tables."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 2, 3.0, "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA + ", row int, node string, n int, score double, `count` string")
    return make
