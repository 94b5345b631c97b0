"""All queries of the library's own operators by name, and their SQL."""

from tilelake.plans import archive_queries, catalog_queries, file_queries, highlight_queries, history_queries, index_queries, merge_queries, store_queries, tile_queries

_FAMILIES = (highlight_queries, index_queries, tile_queries, history_queries, merge_queries, catalog_queries, archive_queries, file_queries, store_queries)
QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: sql for family in _FAMILIES for name, sql in family.ORACLES.items()}
