"""Registered queries over the given tables and the SQL that states their results."""

from . import text_queries
from . import more_queries, score_queries, stat_queries, study_queries  # noqa: F401  add to the registry

QUERIES = text_queries.QUERIES
SQL = text_queries.SQL
