"""Queries over the driver tables, one module per area."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that its queries register."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
