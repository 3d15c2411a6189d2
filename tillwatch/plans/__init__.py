"""Query catalogue and job plans."""

from importlib import import_module

MODULES = ("detectors", "reports", "issue_queries", "action_queries", "document_queries", "quality_queries")


def all_queries():
    from tillwatch.plans.catalog import QUERIES

    for name in MODULES:
        import_module(f"tillwatch.plans.{name}")
    return dict(QUERIES)
