"""Every operator as a query over the given tables, with its SQL counterpart where SQL can say it."""

import importlib

MODULES = ["functions_catalog", "retrieval_catalog", "curation_catalog"]


def load():
    """(queries, oracles) of all catalog modules."""
    from memloom.catalog.registry import ORACLES, QUERIES

    for module in MODULES:
        importlib.import_module(f"memloom.catalog.{module}")
    return QUERIES, ORACLES
