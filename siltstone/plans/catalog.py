"""All queries of the library over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from siltstone.plans import entities, graph, ingest, models, operations, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (entities, graph, ingest, models, vectors, operations):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
