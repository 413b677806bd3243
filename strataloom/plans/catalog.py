"""All queries of the core and their SQL."""

from __future__ import annotations

from strataloom.plans import detail_queries, hierarchy_queries, knowledge_queries, orphan_queries, structure_queries, survey_queries, text_queries, unit_queries, validation_queries

_MODULES = (orphan_queries, hierarchy_queries, unit_queries, knowledge_queries, text_queries, structure_queries, validation_queries, detail_queries, survey_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
