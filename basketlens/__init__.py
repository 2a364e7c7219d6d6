"""Adoption analytics over registered item baskets, on Spark DataFrames."""

from .config import DECKLISTS, STAR, EngineConfig

__all__ = ["DECKLISTS", "STAR", "EngineConfig"]
