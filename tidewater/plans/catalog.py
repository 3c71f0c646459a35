"""All queries of the engine by name, with the DuckDB statement of each."""

from __future__ import annotations

from ..streaming import events
from . import decisions, discovery, evidence, governance, models, policies, portfolio, relational, scalars, scenarios, selection, serving, snapshots, sources, vectorised

PARTS = (evidence, relational, decisions, discovery, models, portfolio, scenarios, selection, governance, snapshots, serving, scalars, sources, vectorised, policies, events)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE: dict = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
