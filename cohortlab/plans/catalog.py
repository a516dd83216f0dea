"""All registered queries of the panel engine, and their SQL."""

from __future__ import annotations

from . import clustering, inference, relational, text

_MODULES = (relational, clustering, inference, text)
QUERIES = {name: f for m in _MODULES for name, f in m.registry.queries.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.registry.sql.items()}
