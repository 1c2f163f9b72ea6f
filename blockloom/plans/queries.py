"""Queries over the test tables for the tensor engine, each with its SQL twin."""

from __future__ import annotations

from . import catalog_queries, matrix_queries, model_queries

QUERIES: dict = matrix_queries.QUERIES | catalog_queries.QUERIES | model_queries.QUERIES
ORACLES: dict[str, str] = matrix_queries.ORACLES | catalog_queries.ORACLES | model_queries.ORACLES
