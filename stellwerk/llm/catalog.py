"""Collects the registered queries of the subpackage."""

from __future__ import annotations

from stellwerk.llm import queries

QUERIES = dict(queries.QUERIES)
CHECKS = dict(queries.CHECKS)
