"""Composed jobs and the registry of queries on the driver tables."""


def all_queries():
    """Import every query module so that the registry is complete; return it."""
    from labelset.plans import (  # noqa: F401
        generation_tables, ingest_tables, match_tables, scoring_tables, text_tables)
    from labelset.plans.registry import REGISTRY

    return REGISTRY
