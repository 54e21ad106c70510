"""Every query of the library: name -> (spark, sf_dir) -> DataFrame, with its SQL twin."""

from __future__ import annotations

from .plans import annotate, dense_queries, geometry_queries, long_queries, model_queries, published_queries, relational_queries, scoring_queries, sequence_queries, signal_queries, stateful_queries, window_queries  # noqa: F401
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "q_phase_motion_snr"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
