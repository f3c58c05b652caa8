"""Importing the modules registers their queries."""

from checks import (  # noqa: F401
    q_evidence,
    q_history,
    q_operations,
    q_pixels,
    q_scalars,
    q_streams,
)
from checks.registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
