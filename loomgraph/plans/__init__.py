"""Named queries over the test tables, with their SQL twins."""

from __future__ import annotations

import importlib
import pkgutil


def load_core():
    """The registry of the core queries, with every query module of this package loaded."""
    from loomgraph.plans.registry import core

    for m in pkgutil.iter_modules(__path__):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")
    return core
