"""Queries over the bundled tables; importing this module registers them."""

from palimpsest.plans import aggregates, documents, filters, history, joins, records, retrieval, scalars, streams  # noqa: F401
