"""All registered queries."""

from __future__ import annotations

from eddyfield.plans import (  # noqa: F401
    archive_queries,
    growing_queries,
    ingest_queries,
    motion_queries,
    native_queries,
    profile_queries,
    regrid_queries,
    select_queries,
    stats_queries,
    stencil_queries,
)
from eddyfield.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
