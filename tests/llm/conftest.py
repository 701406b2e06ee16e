"""Small documents with awkward cases."""

from __future__ import annotations

import pytest

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away today", "en", "s", 3),
    (2, "The quick brown fox jumps over the lazy dog and runs far away today", "en", "s", 3),
    (2, "The quick brown fox jumps over the lazy dog and runs far away today", "en", "s", 3),
    (3, None, None, None, None),
    (4, "", "en", "s", 0),
    (5, "", "en", None, 0),
    (6, "  \t\n ", "en", "s", 4),
    (None, "no id here", "en", "s", 4),
    (None, "The quick brown fox jumps over the lazy dog and runs far away today", "en", "s", 4),
    (8, "word " * 3000, "en", "s", 15000),
    (9, "Zurück für Ärger übermäßig — 漢字 ½", "de", "s", 10),
    (10, "x", "en", "s", 1),
]
#: Names that the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, kept string, score string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, 7, 8, "k", "s") for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return ROWS
