import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [
        (1, "The MIT License. Released under the mit license, General Public License", "en", "a"),
        (1, "The MIT License. Released under the mit license, General Public License", "en", "a"),
        (2, None, "en", "b"), (3, "", None, None), (4, " \t\n", "fr", ""), (5, LONG, "en", "a"),
        (None, "no id at all but words enough to be a text of some length", "en", None), (None, None, None, None),
        (6, "one\x1ctwo\x85three four ÀÉ Ünïcode K", "de", "b"), (7, "#*$%&|<>", "fr", "c"),
    ]
    clash = ", 0L AS size, 'x' AS label, 1 AS kept, 2 AS score, 3 AS row, 'y' AS key, 4 AS fp, 5 AS words, 6 AS n, 7 AS __kept, 8 AS __known, 9 AS n_words"
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.createOrReplaceTempView("odd_docs_rows")
    return spark.sql(f"SELECT *{clash} FROM odd_docs_rows").cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
