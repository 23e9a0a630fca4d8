"""Queries of the core operators, and SQL that checks them."""

from __future__ import annotations

from lexloom.plans import analytics, annotate, files, phono, quotas, retrieve, vectors, vocabulary

_PARTS = [quotas.plans, annotate.plans, retrieve.plans, vocabulary.plans, vectors.plans, phono.plans, files.plans, analytics.plans]
QUERIES = {name: q for part in _PARTS for name, q in part.queries.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.oracles.items()}
