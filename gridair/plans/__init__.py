"""Registered queries: one module per family, collected by ``load``."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module once and return the registry."""
    for m in pkgutil.iter_modules(__path__):
        if m.name != "registry":
            importlib.import_module(f"{__name__}.{m.name}")
    from gridair.plans import registry
    return registry
