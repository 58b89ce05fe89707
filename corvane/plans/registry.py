"""Registered queries of the screening engine."""

from corvane.plans import analytics, screening, upkeep

QUERIES: dict = {**screening.QUERIES, **analytics.QUERIES, **upkeep.QUERIES}
ORACLES: dict = {**screening.ORACLES, **analytics.ORACLES, **upkeep.ORACLES}
