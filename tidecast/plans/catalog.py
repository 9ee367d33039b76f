"""All queries and all SQL twins."""

from __future__ import annotations

from tidecast.plans import dashboard, exploration, forecasting, modelling, scoring

_PARTS = (dashboard, exploration, modelling, forecasting, scoring)

QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
ORACLE = {name: text for part in _PARTS for name, text in part.ORACLE.items()}
