"""Catalog of runnable queries."""

from __future__ import annotations

import importlib

MODULES = ["tables", "checks", "relations", "statistics", "spatial", "factors", "transport", "fitted", "report_tables"]


def load_catalog():
    from fovea.plans.catalog import CATALOG

    for name in MODULES:
        importlib.import_module(f"fovea.plans.{name}")
    return CATALOG
