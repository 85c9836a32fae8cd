"""Queries that exercise every operator on whole tables, with equivalent SQL."""

import importlib

_MODULES = ["pii", "policy", "governed", "joins", "state", "entities", "questions", "audit", "discovery", "landed", "streams"]


def load_all():
    """(queries, oracle SQL) of all modules."""
    from workload import registry

    for name in _MODULES:
        importlib.import_module(f"workload.{name}")
    return registry.QUERIES, registry.ORACLE
