"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from ripplework.plans import q_runs, q_scores, q_segments, q_sequence, q_statistics, q_tables, q_vectors  # noqa: F401  they register
from ripplework.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
