"""The registered queries and the SQL they are held against."""

from __future__ import annotations

from . import answers, corpus, indexing, searching, urls

PARTS = (urls, corpus, indexing, searching, answers)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
