"""Named queries over the driver tables, and their SQL."""

from . import gateway_queries, knowledge_queries, search_queries, text_queries

_PARTS = (search_queries, knowledge_queries, text_queries, gateway_queries)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
