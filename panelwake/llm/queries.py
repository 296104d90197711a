"""All queries of this subpackage."""

from __future__ import annotations

from panelwake.llm import (  # noqa: F401
    alignment,
    bpe,
    chat_format,
    collocations,
    decontaminate,
    language,
    line_dedup,
    near_dup,
    repeats,
    secrets,
    simhash,
    token_files,
    vector_search,
)
from panelwake.llm.common import ORACLES, QUERIES  # noqa: F401
