"""Queries of the training-data operators, by their module, and their SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_names", "q_splitting", "q_matching", "q_scans", "q_neighbours", "q_tokens", "q_mixing", "q_levels")

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = import_module(f"chronoloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
