"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from loomwright.plans import collection, extensions, flows, incremental, lookups, measures, nested, pages, records, streams

_MODULES = (incremental, records, flows, measures, extensions, streams, pages, lookups, nested, collection)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
