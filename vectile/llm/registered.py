"""Where the queries of this subpackage register."""

from __future__ import annotations

from vectile.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


def tokenizer(name: str) -> str:
    """A public vocabulary file; the package that knows the place is only needed by the queries."""
    import public_tokenizers

    return public_tokenizers.path(name)
