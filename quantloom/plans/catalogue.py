"""All queries of the market-analytics engine with their SQL equivalents."""

from __future__ import annotations

from quantloom.plans import evaluation, features, flow, market, models, price, streams

_MODULES = (price, flow, market, features, streams, evaluation, models)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in _MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
