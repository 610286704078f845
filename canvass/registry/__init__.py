"""All queries with their SQL counterparts."""

import importlib

from canvass.registry.base import ORACLES, QUERIES

MODULES = ["filters", "parsing", "matching", "searching", "tables", "pages", "streams"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"canvass.registry.{name}")


__all__ = ["ORACLES", "QUERIES", "load_all"]
