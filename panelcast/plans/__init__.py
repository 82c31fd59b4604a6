"""Registered queries: the operators run on the given tables."""

from __future__ import annotations

import importlib

MODULES = ("windows", "features", "metrics", "scoring", "panel", "pit", "odds", "squads", "io", "priors", "models")


def load():
    """Import every module of registered queries and return the registry."""
    from panelcast.plans import registry

    for name in MODULES:
        importlib.import_module(f"panelcast.plans.{name}_queries")
    return registry
