from __future__ import annotations

import pytest

from panelwake.llm.common import prepared

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "name string, line string, shard int, ids string, term string, h string, node string, "
    "score string, kept string, lang_pred string, lines string, gone string, start string"
)
CLASH = ("x", "x", 1, "x", "x", "x", "x", "x", "x", "x", "x", "x", "x")


@pytest.fixture(scope="session")
def lake(spark):
    return prepared(spark)


@pytest.fixture(scope="session")
def make(lake):
    """Documents from (doc_id, text[, lang, source]) with columns that clash with internal names."""

    def table(rows):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, len(text or ""), *CLASH))
        return lake.createDataFrame(full, SCHEMA)

    return table


def words(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(n))
