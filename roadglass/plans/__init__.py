"""Queries that bind the operators to the supplied tables, each with the SQL that checks it."""

from . import events, fleet, measures, streams

_MODULES = (events, fleet, measures, streams)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
