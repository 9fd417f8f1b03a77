"""Named queries over the views, each with its SQL twin where one exists."""

from importlib import import_module

MODULES = ["text_queries", "story_queries", "engine_queries", "stream_queries"]


def load_all():
    """Import every query module once and return the registry."""
    for name in MODULES:
        import_module(f"storyhub.plans.{name}")
    from storyhub.plans.catalog import QUERIES

    return QUERIES
