"""All queries of the exam-bank operators by name, and their SQL."""

from __future__ import annotations

from certame.plans import answers, files, questions, rest, tables, texts  # noqa: F401  they register their queries
from certame.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
