"""Registered queries of the core engine, one module per family."""

from __future__ import annotations

import importlib

from ..registry import Registry

_FAMILIES = ("storage", "statistics", "duplicates", "samples", "evaluation", "labels", "moves", "names", "filters", "roundtrips", "streams")


def registry() -> Registry:
    """All core queries; later registration of a name twice raises."""
    whole = Registry()
    for family in _FAMILIES:
        part = importlib.import_module(f"{__name__}.{family}").REGISTRY
        for name, fn in part.fns.items():
            whole.add(name, part.sql.get(name))(fn)
    return whole
