"""All registered queries of the library."""

from plumbline.plans import queries, queries_files, queries_inference, queries_universe

QUERIES = {**queries.QUERIES}
ORACLE_SQL = {**queries.ORACLE_SQL}
MODULES = (queries, queries_universe, queries_inference, queries_files)
