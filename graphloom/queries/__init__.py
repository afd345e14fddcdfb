"""Registered queries by family: each module has QUERIES and ORACLES with equal keys."""

from __future__ import annotations

from graphloom.queries import kg, metrics, scores, sparql, streams, text

MODULES = [sparql, kg, text, scores, metrics, streams]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
