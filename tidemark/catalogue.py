"""Every registered query with its oracle; importing the modules of ``tidemark.plans`` fills both."""

from __future__ import annotations

from tidemark.plans import bars, evaluation, models, panel  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
