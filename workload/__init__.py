"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib

from workload.registry import ORACLES, QUERIES

MODULES = ("profiles", "catalogs", "texts", "vectors", "metadata", "charts", "logs", "streams")


def load_all():
    """(queries, oracles) after importing every workload module."""
    for name in MODULES:
        importlib.import_module(f"workload.{name}")
    return QUERIES, ORACLES
