"""The registered workload: one query per operator, over the whole input tables."""

from __future__ import annotations

import importlib
import pkgutil


def registered():
    """All queries and SQL twins."""
    from clipmart.workload import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
