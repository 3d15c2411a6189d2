from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(20_000))
SHARED = " ".join(f"shared{i}" for i in range(60))
#: Nulls, blanks, very long texts, ties, repeated rows.
TEXTS = [
    None, "", "   \n\t ", "one", LONG, "The " * 300, "a" * 3000, "é" * 500, "x " * 4 + SHARED + " tail", SHARED, SHARED, "start " + SHARED,
    "The quick brown fox jumps over the lazy dog. " * 8, "mail bob.smith@example.com or call +1 (555) 123-4567 now",
    "card 4111 1111 1111 1111 and 10.0.0.1 and 256.1.1.1 password=aaaa1111bbbb2222cc", "日本語 テキスト 😀 mixed", "## $$ %% && ||",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with null ids, repeated rows, and extra columns whose names clash with those that operators add."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "x", 7, "y") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here at all", None, None, None, "x", 7, "y"), rows[12], rows[12]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, spans int, row string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
