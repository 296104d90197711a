"""All registered queries."""

from __future__ import annotations

from panelwake.plans import (  # noqa: F401
    association_queries,
    contract_queries,
    ingest_queries,
    model_queries,
    panel_queries,
    ranking_queries,
    stated_queries,
    strata_queries,
    stream_queries,
)
from panelwake.plans.registry import ORACLES, QUERIES  # noqa: F401
