import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

LONG = "Of the long tale of words that never ends, it says. " * 20000
#: doc_id, text, source, lang: nulls in every column, empty and blank texts, repeated rows, ties, other scripts, one very long text.
EDGE = [
    (1, None, "a", "en"),
    (2, "", "a", None),
    (3, " \t\n ", None, "en"),
    (4, "One two three four.", "b", "en"),
    (4, "One two three four.", "b", "en"),
    (5, "one TWO three four.", "b", None),
    (None, "A row without an id, but with a text of some words.", None, None),
    (6, "ПРИВЕТ мир, это текст без номера. " * 12, "a", "ru"),
    (7, "漢字だけの文。", "c", "ja"),
    (8, LONG, "c", "en"),
    (9, "Mail anna.lee@mail.example.com or call +1 (212) 555-0199, says Mrs. Anna Smith.", "c", "en"),
    (10, "Écrire à Mme Claire Dubois, carte 4111 1111 1111 1111, adresse 10.1.2.3 ou anna.lee@mail.example.com.", "c", "fr"),
    (11, "x", "a", "en"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows, with extra columns whose names clash with outputs."""
    rows = [(*r, 0, "old", "old") for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words int, score string, size string").repartition(3)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("1 = 0")
