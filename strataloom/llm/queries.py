"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from strataloom.llm import leakage_queries, lookalike_queries, mixing_queries, reading_level_queries, scanned_queries, sentence_queries

_MODULES = (lookalike_queries, leakage_queries, mixing_queries, reading_level_queries, scanned_queries, sentence_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
