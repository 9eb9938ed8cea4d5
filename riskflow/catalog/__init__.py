"""Named queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ["record_queries", "feature_queries", "report_queries", "stream_queries"]


def load_all():
    """(queries by name, check SQL by name)."""
    from riskflow.catalog import registry

    for module in MODULES:
        importlib.import_module(f"riskflow.catalog.{module}")
    return registry.QUERIES, registry.ORACLES
