"""The queries of this subpackage and their SQL."""

from memloom.llm import queries as _queries


def load():
    """(queries, oracles)."""
    return _queries.QUERIES, _queries.ORACLES
