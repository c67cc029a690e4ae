"""Queries over the driver's tables with their oracles, one module a family.

Inputs that are no table of their own (the star schema as a property graph,
documents as a search corpus, events as a usage log) are views given as one SQL
text, read by both engines; the operators themselves are written twice.
"""

from __future__ import annotations

from . import derive, graph, resolve, search, text, usage

MODULES = (search, text, graph, resolve, derive, usage)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
