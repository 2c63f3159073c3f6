"""Composed plans and the query catalogue."""

import importlib
import pkgutil


def load_catalog() -> None:
    """Import every ``catalog_*`` module once, which registers its queries."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("catalog_")):
        importlib.import_module(f"{__name__}.{module}")
