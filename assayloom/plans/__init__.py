"""Registered queries: bindings of the given tables to the operators."""

import importlib

MODULES = ("screening", "contacts", "features", "models", "signals", "structures", "files", "live")


def all_queries() -> None:
    """Import every query module once, which registers its queries."""
    for name in MODULES:
        importlib.import_module(f"assayloom.plans.{name}")
