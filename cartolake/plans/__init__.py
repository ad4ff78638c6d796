"""Registered queries and their SQL."""

from . import activity, catalogue, discovery, places

QUERIES = places.QUERIES | activity.QUERIES | discovery.QUERIES | catalogue.QUERIES
ORACLE_SQL = places.ORACLE_SQL | activity.ORACLE_SQL | discovery.ORACLE_SQL | catalogue.ORACLE_SQL
