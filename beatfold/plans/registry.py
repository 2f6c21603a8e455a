"""Queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from beatfold.plans import beats, burden, clusters, evaluation

QUERIES: dict = {}
ORACLES: dict = {}
for module in (burden, beats, evaluation, clusters):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
