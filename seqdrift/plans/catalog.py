"""All registered queries of the library and the SQL they are held against."""

from seqdrift.plans import detector_queries, event_queries, token_queries

_MODULES = (token_queries, event_queries, detector_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
