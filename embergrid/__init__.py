"""Gridded event harmonization and calendar analytics on Spark DataFrames."""

from embergrid.config import Config

__all__ = ["Config"]
