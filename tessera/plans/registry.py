"""Named queries of the library and their SQL equivalents."""

from __future__ import annotations

from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict:
    return dict(ORACLES)
