"""Named queries over the project's tables, module by module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("periods", "relational", "search", "graphs", "upkeep")


def _gather(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"chronoloom.plans.{module}"), name)
        if twice := found.keys() & part.keys():
            raise ValueError(f"defined twice: {twice}")
        found |= part
    return found


def all_queries() -> dict:
    return _gather("QUERIES")


def all_oracles() -> dict:
    return _gather("ORACLE")
