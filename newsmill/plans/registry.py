"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from ..operators import timestamps
from . import discovery_plans, page_plans, reading_plans, relational_plans, source_plans, state_plans, text_plans, url_plans

_PLANS = [url_plans, text_plans, relational_plans, source_plans, state_plans, page_plans, discovery_plans, reading_plans]
QUERIES = {"p7_found": timestamps.p7_found}
ORACLE: dict[str, str] = {}
for _p in _PLANS:
    QUERIES |= _p.QUERIES
    ORACLE |= _p.ORACLE
