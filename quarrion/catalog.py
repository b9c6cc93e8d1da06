"""Registered queries by name, with their SQL."""

from __future__ import annotations

from quarrion.plans import clusters, code, lists, scalars, sets, strings, summaries, texts
from quarrion.plans.registry import ORACLES, QUERIES

FLAGSHIP = "flagship_step_summary"
MODULES = (clusters, code, lists, scalars, sets, strings, summaries, texts)

__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
