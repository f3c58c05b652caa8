"""Scheduled-departure wait analytics as Spark DataFrame operators."""

from tidewait.params import Params

__all__ = ["Params"]
