"""Queries over the driver's tables, with the SQL that checks them."""

from . import batches, clashes, documents, frames, hierarchy, lookups, models, values

_MODULES = (documents, hierarchy, values, clashes, batches, frames, models, lookups)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "latest_revision"
