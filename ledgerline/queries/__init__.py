"""Registered queries: each operator on the given tables, with its SQL twin."""

from ledgerline.queries.registry import QUERIES, SQL

from ledgerline.queries import (  # noqa: E402,F401  (imports register the queries)
    rows, link, temporal, profiles, stats, cleaning, linkage, sources, models, retrieval,
)

__all__ = ["QUERIES", "SQL"]
