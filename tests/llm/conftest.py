from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def build(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


def paragraph(seed: int, words: int) -> str:
    """Words that no other seed has."""
    return " ".join(f"w{seed}x{i}" for i in range(words))
