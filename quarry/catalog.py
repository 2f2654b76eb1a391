"""Registered queries and their SQL twins, gathered from the plan modules."""

from __future__ import annotations

from quarry.plans import events, files, govern, graph, more, packs, records, similarity, streams, text, web

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (events, text, similarity, web, graph, govern, packs, more, files, streams, records):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
