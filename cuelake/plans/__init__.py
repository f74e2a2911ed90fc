"""Registered queries: the operators bound to the given tables, each with its SQL twin."""

from importlib import import_module

MODULES = ["matching", "ingest", "catalogue", "timeline", "exports", "worklist", "exchange", "streams"]


def all_queries():
    from cuelake.plans.registry import ORACLES, QUERIES
    for name in MODULES:
        import_module(f"cuelake.plans.{name}")
    return QUERIES, ORACLES
