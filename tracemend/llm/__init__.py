"""Training-data operators; nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name)]


def queries() -> dict[str, Callable]:
    return {k: f for m in _modules() for k, f in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in getattr(m, "ORACLES", {}).items()}
