"""Queries by name over the tables of a folder, with DuckDB SQL that says the same."""

from . import artifacts, inference, models, quality, retrieval, review, statistics, text  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
