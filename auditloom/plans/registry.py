"""All registered queries."""

from __future__ import annotations

from functools import lru_cache
from importlib import import_module

from auditloom.plans.catalog import Catalog

MODULES = ("q_features", "q_rules", "q_tables", "q_monitor", "q_status", "q_quality", "q_stream")


@lru_cache(maxsize=1)
def catalog() -> Catalog:
    cat = Catalog()
    for name in MODULES:
        import_module(f"auditloom.plans.{name}").register(cat)
    return cat
