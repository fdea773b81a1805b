"""Registered queries, each with the SQL that gives the same rows where SQL can.

``registry`` maps a name to (query, sql or None).
"""

from __future__ import annotations

from importlib import import_module

MODULES = ["dataset", "evaluation", "perturbation", "auditing", "sources"]


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        found = import_module(f"eraloom.catalog.{name}").CATALOG
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"repeated query names {sorted(clash)}")
        out.update(found)
    return out
