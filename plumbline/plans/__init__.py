"""Importing the package registers every query."""

from plumbline.plans import (  # noqa: F401
    charts,
    drifts,
    governance,
    profiles,
    relational,
    semantic,
    sources,
)
from plumbline.plans.registry import QUERIES, SQL, runner

__all__ = ["QUERIES", "SQL", "runner"]
