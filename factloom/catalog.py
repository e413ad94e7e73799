"""Every query of the engine by name, with the SQL it is compared with."""

from .plans import code_queries, data_queries, fact_queries, graph_queries, library_queries, text_queries

FLAGSHIP = "blast_radius"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for part in (graph_queries, fact_queries, text_queries, library_queries, code_queries, data_queries):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
