"""All core queries, by name."""

from __future__ import annotations

from tidewright.plans import authority, content, entities, extraction, gain, graph, logs, problems, records, routing, sources, streams

MODULES = [problems, routing, logs, content, graph, sources, streams, extraction, authority, entities, gain, records]


def queries():
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles():
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}


def flagship(spark, sf):
    return routing.stm05_resolve(spark, sf)
