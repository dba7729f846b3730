"""Queries over the driver's tables, each with its SQL counterpart."""

from __future__ import annotations

import importlib
import pkgutil

from headway.catalog.registry import QUERIES, Query


def load() -> dict[str, Query]:
    """All registered queries, by name."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return QUERIES
