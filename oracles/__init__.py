"""Plain SQL statements of what the registered queries return."""

from .registry import ORACLES

__all__ = ["ORACLES"]
