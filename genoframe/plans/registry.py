"""All named queries with their SQL."""

from __future__ import annotations

from importlib import import_module

from .catalog import ORACLES, QUERIES

for _family in ("intervals", "tables", "sequences", "reads", "variants", "annotations", "expression", "biology", "formats"):
    import_module(f"{__package__}.{_family}")

__all__ = ["ORACLES", "QUERIES"]
