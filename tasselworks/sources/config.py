"""Configuration and source resolution: plain values on the driver."""

from __future__ import annotations

import os


def load_config(path: str) -> dict:
    """YAML mapping of a file; json is understood without the yaml library."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text) or {}


def is_present(path: str) -> bool:
    """True if the folder exists and holds anything."""
    return os.path.isdir(path) and next(os.scandir(path), None) is not None


def resolve_source(path: str, available: tuple[str, ...], wanted: str = "auto", order: tuple[str, ...] = ("hub", "drive"), force: bool = False) -> str | None:
    """Which source a download would take: none if the data are there and not forced, else the wanted one, else the
    first of ``order`` that is available. Nothing is fetched."""
    if is_present(path) and not force:
        return None
    for name in order if wanted == "auto" else (wanted,):
        if name in available:
            return name
    raise ValueError(f"no source available among {', '.join(order)}")
